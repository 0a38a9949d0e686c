"""Dates as labels print them: day first, two- or four-digit years, or a month name and a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The forms of printed dates.
DATE = r"(?:\d{1,2}\s*[/\-]\s*\d{1,2}(?:\s*[/\-]\s*\d{2,4})?|\d{1,2}\s*\.\s*\d{1,2}\s*\.\s*\d{2,4})"
DAY_FIRST = r"^\s*(\d{1,2})\s*([/.\-])\s*(\d{1,2})\s*\2\s*(\d{2}|\d{4})\s*$"


def looks_like_date(c: Column) -> Column:
    return c.rlike(f"^{DATE}$")


def full_date(c: Column, blanks: str = "") -> Column:
    """The date of a day-month-year text; years 69 to 99 are of the last century. Null where no such day exists."""
    pattern = rf"^(\d{{1,2}}){blanks}([/.\-]){blanks}(\d{{1,2}}){blanks}\2{blanks}(\d{{4}}|\d{{2}})$"
    part = lambda g, name: F.regexp_extract(c, pattern, g).alias(name)

    def of(p: Column) -> Column:
        year = p["y"].try_cast("int") + F.when(F.length(p["y"]) > 2, 0).when(p["y"] >= "69", 1900).otherwise(2000)
        named = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0"))
        return F.when(p["d"] != "", F.try_to_date(named, "yyyy-MM-dd"))  # texts of other forms are not parsed: each failure is an exception

    return let(F.struct(part(1, "d"), part(3, "m"), part(4, "y")), of)


def parse_date(c: Column) -> Column:
    """ISO text of a printed date, or null. Month names stand for the first of the month."""

    def month(named: Column) -> Column:
        return F.coalesce(F.try_to_date(F.when(named.rlike(r"^[A-Za-z]{3} \d{4}$"), named), "MMM yyyy"), F.try_to_date(F.when(named.rlike(r"^[A-Za-z]{3,} \d{4}$"), named), "MMMM yyyy"))

    return F.when(c.isNotNull(), let(F.trim(c), lambda text: F.date_format(F.coalesce(full_date(text), let(F.initcap(F.lower(text)), month)), "yyyy-MM-dd")))


def normal_date(raw: Column) -> Column:
    return F.coalesce(parse_date(raw), raw)


def plausible_packing_date(c: Column, as_of: Column) -> Column:
    """False only for full dates that do not exist or lie after as_of; dates without a year pass."""
    full = lambda bare: F.when(bare.rlike(r"^\d{1,2}([/.\-])\d{1,2}[/.\-]\d{2,4}$"), F.coalesce(full_date(bare) <= as_of, F.lit(False))).otherwise(F.lit(True))
    return let(F.regexp_replace(c, r"\s+", ""), full)
