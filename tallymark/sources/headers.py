"""Sizes of images from the first bytes of their files, as Column expressions: no decoder sees a file that is refused.

PNG keeps width and height in its first chunk, GIF and BMP have them at fixed places. A JPEG file is a chain of segments, each with its length; the frame's
segment holds the size. The chain is followed for SEGMENTS steps, which is more than cameras and editors write before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..functions.text import let
from .readers import EMPTY, INVALID, TOO_LARGE

SEGMENTS = 256
#: The beginnings of files, and the JPEG markers of frames.
PNG, JPEG, GIF, BMP = bytes.fromhex("89504e470d0a1a0a"), bytes.fromhex("ffd8"), b"GIF8", b"BM"
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))


def number(content: Column, at: Column | int, size: int) -> Column:
    """The big-endian number in size bytes from position at (from 0); null beyond the end."""
    part = F.substr(content, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def little(content: Column, at: int, size: int) -> Column:
    """The number in size bytes from position at, its lowest byte first."""
    total = number(content, at, 1)
    for k in range(1, size):
        total = total + number(content, at + k, 1) * 256**k
    return total


def gif_size(content: Column) -> Column:
    return F.struct(little(content, 6, 2).alias("width"), little(content, 8, 2).alias("height"))


def bmp_size(content: Column) -> Column:
    """Rows that are stored from the top have a negative height."""
    height = little(content, 22, 4)
    return F.struct(little(content, 18, 4).alias("width"), F.when(height >= 2**31, 2**32 - height).otherwise(height).alias("height"))


def png_size(content: Column) -> Column:
    """struct<width, height>; null members where the first chunk is cut off or another one."""
    first = F.substr(content, F.lit(13), F.lit(4)) == F.lit(b"IHDR")
    return F.struct(F.when(first, number(content, 16, 4)).alias("width"), F.when(first, number(content, 20, 4)).alias("height"))


def jpeg_size(content: Column) -> Column:
    """struct<width, height> of the first frame; null members where the chain of segments ends before it or breaks."""
    state = "struct<at:bigint,width:bigint,height:bigint>"
    start = F.struct(F.lit(2).alias("at"), F.lit(None).alias("width"), F.lit(None).alias("height")).cast(state)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, length = number(content, at, 2), number(content, at + 2, 2)
        kind = marker % 256
        broken = marker.isNull() | (F.floor(marker / 256) != 0xFF)
        frame = F.struct(F.lit(None).alias("at"), number(content, at + 7, 2).alias("width"), number(content, at + 5, 2).alias("height"))
        end = F.struct(F.lit(None).alias("at"), F.lit(None).alias("width"), F.lit(None).alias("height"))
        alone = (kind == 0x01) | kind.between(0xD0, 0xD7) | (kind == 0xFF)  # markers without a length, and a fill byte
        following = F.when(kind == 0xFF, at + 1).when(alone, at + 2).otherwise(at + 2 + length)
        onward = F.struct(following.alias("at"), F.lit(None).alias("width"), F.lit(None).alias("height"))
        return F.when(at.isNull(), s).when(broken, end.cast(state)).when(kind.isin(*FRAMES), frame.cast(state)).when(~alone & (length.isNull() | (length < 2)), end.cast(state)).otherwise(onward.cast(state))

    # most files have few segments: the steps for the rest are taken only where the first ones did not decide
    few = F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step)
    return let(few, lambda s: F.when(s["at"].isNull(), s).otherwise(F.aggregate(F.sequence(F.lit(17), F.lit(SEGMENTS)), s, step)))


def image_size(content: Column) -> Column:
    """struct<format, width, height>; a format of null for other files."""
    begins = lambda b: F.substr(content, F.lit(1), F.lit(len(b))) == F.lit(b)

    def sized(name: str, size: Column) -> Column:
        return let(size, lambda s: F.struct(F.lit(name).alias("format"), s["width"].alias("width"), s["height"].alias("height")))

    none = F.lit(None).cast("struct<format:string,width:bigint,height:bigint>")
    kinds = (("png", PNG, png_size), ("jpeg", JPEG, jpeg_size), ("gif", GIF, gif_size), ("bmp", BMP, bmp_size))
    out = none
    for name, start, size in reversed(kinds):
        out = F.when(begins(start), sized(name, size(content))).otherwise(out)
    return out


def sniffed(files: DataFrame, context: RunContext = RunContext()) -> DataFrame:
    """files (content, and length where it is known) with format, width, height, error_code and error, null for files that
    may go to a decoder. Emptiness, bytes, format, pixels and sides are tested in this order."""
    length = F.col("length") if "length" in files.columns else F.length("content")
    seen = files.withColumn("tm_size", F.when(length <= context.max_upload_bytes, image_size(F.col("content"))))
    width, height = F.col("tm_size.width"), F.col("tm_size.height")
    # The messages.
    cases = [
        (F.coalesce(length, F.lit(0)) == 0, EMPTY, "Uploaded file is empty."),
        (length > context.max_upload_bytes, TOO_LARGE, "Uploaded file exceeds the maximum allowed size."),
        (width.isNull() | height.isNull(), INVALID, "Unsupported or unreadable image."),
        (width * height > context.max_pixels, INVALID, "Image resolution is unreasonably large."),
        (F.least(width, height) < context.min_side, INVALID, "Image resolution is too small to process."),
    ]
    code, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, c, t in reversed(cases):
        code, text = F.when(cond, c).otherwise(code), F.when(cond, t).otherwise(text)
    return seen.withColumns({"format": F.col("tm_size.format"), "width": width, "height": height, "error_code": code, "error": text}).drop("tm_size")
