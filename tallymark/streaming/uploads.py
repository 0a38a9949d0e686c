"""A stream of uploaded files: each content once, refused ones with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..context import RunContext
from ..functions.text import safe_file_name
from ..sources.headers import sniffed
from ..sources.sinks import append_batch

FILES = "path string, modificationTime timestamp, length long, content binary"


def uploads(files: DataFrame, delay: str, context: RunContext = RunContext()) -> DataFrame:
    """files (a stream of FILES) with name, sha256 and the header's verdict. Of equal contents that come within delay of one
    another one is kept: their hashes are the stream's state, which the watermark bounds."""
    named = files.withColumns({"name": safe_file_name(F.regexp_extract("path", r"([^/]*)$", 1)), "sha256": F.sha2("content", 256)})
    once = named.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return sniffed(once, context).select("path", "modificationTime", "name", "length", "sha256", "format", "width", "height", "error_code", "error", "content")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, delay: str = "1 day", context: RunContext = RunContext()) -> StreamingQuery:
    """Appends the files that come into folder to the table uploads below out, a batch once, until all there are have been read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    write = lambda batch, number: append_batch({"uploads": batch}, out, f"uploads-{number}")
    return uploads(files, delay, context).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
