"""Text functions on label captures. All are Column to Column and null-safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as label engines see it: Unicode blanks and the ASCII separators U+001C to U+001F.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: White space other than a single space or \n.
ODD_SPACE = rf"[{SPACE[1:-1]}&&[^ \n]]|  "

#: Words that start a declaration of its own, contact words, legal forms.
MAJOR = r"^(?i)(?:mrp\b|net\s*(?:wt|weight|we|qty|quantity)\b|use\s+by\b|best\s+before\b|pkd\b|mfd\b|mfg\b|manufactured\b|packed\b|batch\b|lot\b|consumer\s+care\b|customer\s+care\b|phone\s+no\b|ingredients\b|nutrition\s+information\b)"
CONTACT_NOISE = r"(?i)\b(?:queries|contact|phone(?:\s+no)?|e-mail|email|consumer\s+care|customer\s+care|helpline)\b"
LEGAL_FORM = r"(?i)\b(?:PVT\.?\s*LTD|PRIVATE\s+LIMITED|LIMITED|LTD\.?|LLP)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once although lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once a row. They go through a generator of one row, through which the
    optimizer copies no expression into its users, however many they are, nor into a filter below."""
    new = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(new)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def for_matching(c: Column) -> Column:
    """Text ready for label patterns: rupee signs set apart, blanks squeezed within lines, none around colon and slash."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "₹", " ₹ ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" *([:/]) *", "$1")
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    """Cleaned lines, empty ones kept; a break at the very end opens no further line, and empty text has none."""
    trimmed = lambda raw: let(raw, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
    # in most texts blanks are single spaces and lines end with \n: these need no patterns
    plain = F.transform(trimmed(F.split(c, "\n")), lambda x: F.trim(x))
    return F.coalesce(F.when(c.rlike(ODD_SPACE), F.transform(trimmed(F.split(c, LINE_BREAK)), clean)).otherwise(plain), F.array().cast("array<string>"))


def is_major(line: Column) -> Column:
    return line.rlike(MAJOR)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def normal_company(c: Column) -> Column:
    """Company names in a form in which legal words and punctuation do not matter."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"\bprivate\b", "pvt"), r"\blimited\b", "ltd")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def same_company(a: Column, b: Column) -> Column:
    x, y = normal_company(F.coalesce(a, F.lit(""))), normal_company(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def digits_for_letters(c: Column) -> Column:
    """Letters that recognition mistakes for digits, in numeric context."""
    return F.translate(c, "OoIlS", "00115")


def looks_numeric(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"[\s()]", ""), r"(?i)^(?:₹|rs\.?|inr)", "")
    return bare.rlike(r"^[0-9OoIlS.,/]+$")


def rupee_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\b(?:rs\.|rs\b|inr\b)", "₹")


def safe_file_name(c: Column) -> Column:
    kept = F.regexp_replace(F.replace(stripped(c), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9._-]", "")
    return F.coalesce(blank_to_null(F.right(kept, F.lit(100))), F.lit("upload"))


def payload_text(c: Column) -> Column:
    """The text of a decoder's bytes: invalid ones are left out, blanks at the ends too, and nothing is null."""
    return blank_to_null(F.trim(F.replace(F.make_valid_utf8(c.cast("string")), F.lit("\ufffd"), F.lit(""))))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def contact_noise(value: Column, raw: Column) -> Column:
    return F.coalesce(F.coalesce(blank_to_null(value), raw).rlike(CONTACT_NOISE), F.lit(False))
