"""Barcode candidates of decoders and of recognised digits.

barcode_candidates: scan_id, pos, value, type, x, y, w, h. digit_strings: scan_id, region_no, pos, digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import article_numbers

#: Formats that are supported, and those of digits only.
FORMATS = ("EAN13", "EAN8", "UPCA", "UPCE", "CODE128", "CODE39", "QRCODE", "ITF", "I25")
NUMERIC = ("EAN13", "EAN8", "UPCA", "UPCE", "ITF", "I25")


def valid(candidates: DataFrame) -> DataFrame:
    """Candidates with a value, a supported type or none, digits where the type asks for them, and 80 signs at most."""
    kind = F.upper(F.coalesce("type", F.lit("")))
    value = F.trim("value")
    fits = (value != "") & ((kind == "") | kind.isin(*FORMATS)) & (~kind.isin(*NUMERIC) | value.rlike("^[0-9]+$")) & (F.length(value) <= 80)
    return candidates.where(fits).withColumns({"value": value, "type": kind, "area": F.greatest(F.col("w") * F.col("h"), F.lit(0))})


def distinct_codes(candidates: DataFrame) -> DataFrame:
    """The largest candidate of each scan, value and type, the first of equals."""
    order = Window.partitionBy("scan_id", "value", "type").orderBy(F.desc("area"), "pos")
    return candidates.withColumn("tm_rank", F.row_number().over(order)).where("tm_rank = 1").drop("tm_rank")


def best(candidates: DataFrame) -> DataFrame:
    """One code of each scan: known format, retail digits, usual length, then area decide; the first of equals."""
    kept = distinct_codes(valid(candidates))
    retail = F.col("type").isin(*NUMERIC) & F.col("value").rlike("^[0-9]+$")
    known, usual = F.col("type").isin(*FORMATS), F.length("value").between(7, 20)
    order = Window.partitionBy("scan_id").orderBy(known.desc(), retail.desc(), usual.desc(), F.desc("area"), "pos")
    return kept.withColumn("tm_rank", F.row_number().over(order)).where("tm_rank = 1").select("scan_id", "value", "type", "area", "pos")


def rebuilt(digits: DataFrame) -> DataFrame:
    """scan_id, barcode, region_no: the only article number that the digits of the first regions support, at the
    earliest region by which exactly one is supported."""
    by_region = digits.groupBy("scan_id", "region_no").agg(F.array_sort(F.collect_list(F.struct("pos", "digits"))).alias("tm_own"))
    upto = Window.partitionBy("scan_id").orderBy("region_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = by_region.withColumn("tm_all", F.flatten(F.collect_list(F.transform("tm_own", lambda x: x["digits"])).over(upto)))
    codes = so_far.select("scan_id", "region_no", article_numbers(F.col("tm_all")).alias("tm_codes")).where(F.size("tm_codes") == 1)
    return codes.groupBy("scan_id").agg(F.min_by(F.get("tm_codes", F.lit(0)), "region_no").alias("barcode"), F.min("region_no").alias("region_no"))
