"""Writers and table edits: append with running ids, upsert and insert-missing by business key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..context import RunContext
from ..operators.rules import stored_risk, stored_status
from ..storage import stored
from .commits import Log
from .constraints import Guard


def numbered(rows: DataFrame, order: list[Column], last: int = 0, name: str = "scan_id") -> DataFrame:
    """rows with ids last + 1, last + 2, ... in the given order of unique keys.

    Ranges of the order are numbered side by side; one row a range with its size gives the offsets. The ranges are stored
    first: their bounds come from samples, so rows and sizes have to be of one and the same partitioning.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"tm_part": F.spark_partition_id(), "tm_id": F.monotonically_increasing_id()})
    ranged = stored(ranged, "ranges")
    low = ranged.groupBy("tm_part").agg(F.min("tm_id").alias("tm_low"), F.count("*").alias("tm_n"))
    before = F.coalesce(F.sum("tm_n").over(Window.orderBy("tm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = low.select("tm_part", "tm_low", before.alias("tm_before"))
    both = ranged.join(F.broadcast(offsets), "tm_part")
    return both.withColumn(name, F.col("tm_id") - F.col("tm_low") + F.col("tm_before") + 1 + last).drop("tm_part", "tm_id", "tm_low", "tm_before")


def claimed(spark: SparkSession, folder: str, key: str, rows: int) -> dict:
    """The ids first to first + rows - 1, which belong to the batch named key from now on, whoever asks at the same time. A
    batch that asks again gets the range it has."""
    ledger = Log(spark, f"{folder}/ids")

    def next_range(before: list[dict]) -> dict | None:
        if any(e["key"] == key for e in before):
            return None
        return {"key": key, "first": before[-1]["first"] + before[-1]["rows"] if before else 1, "rows": rows}

    entry = ledger.add(next_range) or next(e for e in ledger.entries() if e["key"] == key)
    if entry["rows"] != rows:
        raise ValueError(f"batch {key!r} had {entry['rows']} rows before and has {rows} now")
    return entry


def append_batch(tables: dict[str, DataFrame], folder: str, key: str, order: list[Column] | None = None, **notes: str | None) -> bool:
    """Appends the rows of a batch to tables below folder, all of them or none; False if the batch is there already.

    Files go to folders of their own, which readers (see committed) do not know until the batch's entry in the log names
    them; that is the last step. With an order, the rows of the one table get scan_id from the ledger of ids: each batch
    the range after the last one, a repeated batch the range that it claimed before. Rows that break a constraint of their
    table (see constraints) are found while they are written, and then nothing is committed. notes go into the entry.
    """
    spark = next(iter(tables.values())).sparkSession
    done = Log(spark, f"{folder}/commits")
    if any(e["key"] == key for e in done.entries()):
        return False
    if order is not None:
        (name, rows), = tables.items()
        rows = numbered(rows, order)
        first = claimed(spark, folder, key, rows.count())["first"]
        tables = {name: rows.withColumn("scan_id", F.col("scan_id") + (first - 1))}
    at = f"batch-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        guard = Guard(name)
        guard.watch(rows).write.parquet(f"{folder}/{name}/{at}")
        guard.settle()
    entry = lambda before: None if any(e["key"] == key for e in before) else {"key": key, "paths": {name: f"{name}/{at}" for name in tables}, **notes}
    return done.add(entry) is not None


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows of all batches that are committed; of an unknown table an error."""
    paths = [f"{folder}/{e['paths'][name]}" for e in Log(spark, f"{folder}/commits").entries() if name in e["paths"]]
    if not paths:
        raise ValueError(f"no batch of {name} is committed in {folder}")
    return spark.read.parquet(*paths)


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with source's rows put in by key. A null in source leaves the column as it was."""
    old = target.alias("t").join(source.alias("s"), key, "full_outer")
    return old.select(*(F.col(key) if c == key else F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) for c in target.columns))


def seeded(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with the rows of a seed file put in by key: columns that the table lacks are left out, and so are rows
    without a key. Writing it is up to the caller; comparing it with target first is a dry run."""
    known = [c for c in source.columns if c in target.columns]
    rows = source.where(F.col(key).isNotNull()).dropDuplicates([key]).select(*known)
    return upsert(target, rows.select(*(F.col(c) if c in known else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns)), key)


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target and those rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"))


FIELDS = {
    "mrp": ("mrp", "mrp_raw"), "net_quantity": ("net_quantity", "net_quantity_raw"), "manufacturer": ("manufacturer", "maker_raw"), "manufacturer_address": ("maker_address_raw", "maker_address_raw"),
    "manufacturing_date": ("manufacturing_date", "packing_date_raw"), "packing_date": ("packing_date", "packing_date_raw"), "use_by": ("use_by", "use_by_raw"), "best_before": ("best_before", "best_before_raw"),
    "consumer_care_contact": ("customer_care", "care_raw"), "batch_lot_number": ("batch_raw", "batch_raw"), "country_of_origin": ("origin_raw", "origin_raw"), "brand": ("brand", "brand"),
}


def field_struct() -> Column:
    """struct<field: struct<value, unit, raw, found>> of an evaluated scan."""
    unit = {"net_quantity": F.col("net_quantity_unit"), "mrp": F.col("mrp_currency")}
    one = lambda name, value, raw: F.struct(F.col(value).cast("string").alias("value"), unit.get(name, F.lit(None).cast("string")).alias("unit"), F.col(raw).alias("raw"), F.col(raw).isNotNull().alias("found"))
    return F.struct(*(one(name, *columns).alias(name) for name, columns in FIELDS.items()))


def detail_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The rows of the five result tables of evaluated scans, with the columns of schemas. Confidences, paths and times
    are those of the engines that read the scans, null where results have none."""
    have = lambda name, kind: F.col(name) if name in results.columns else F.lit(None).cast(kind).alias(name)
    rows = results.select("*", *(have(n, k) for n, k in (("ocr_confidence", "double"), ("barcode_confidence", "double"), ("heatmap_path", "string"), ("image_path", "string"), ("image_url", "string"), ("processing_time_ms", "int")) if n not in results.columns))
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    status, risk = stored_status(F.col("overall_status")), stored_risk(F.col("risk_level"))
    tables = {
        "scan_records": rows.select(
            "scan_id", "created_at", "image_path", "image_url", F.nullif("barcode", F.lit("")).alias("detected_barcode"), F.col("ref_product_name").alias("detected_product_name"),
            F.coalesce("ref_brand", "brand").alias("detected_brand"), "reference_product_id", "ocr_confidence", "tampering_score", F.col("overall_status").alias("status"),
        ),
        "ocr_results": rows.select("scan_id", F.col("ocr_text").alias("raw_text"), F.col("ocr_confidence").alias("confidence"), json(field_struct()).alias("structured_data")),
        "barcode_results": rows.select("scan_id", F.nullif("barcode", F.lit("")).alias("barcode"), (F.coalesce("barcode", F.lit("")) != "").alias("detected"), F.col("barcode_confidence").alias("confidence")),
        "tampering_results": rows.select("scan_id", "tampering_score", F.col("tampering_status").alias("status"), "heatmap_path"),
        "compliance_results": rows.select(
            "scan_id", status.alias("overall_status"), risk.alias("risk_level"), F.col("reference_found").alias("reference_match"), json("matched_fields").alias("matched_fields"), json("mismatched_fields").alias("mismatched_fields"),
            json("missing_fields").alias("missing_fields"), json("rule_results").alias("rule_results"), "explanation", "engine_version", "rules_version", "processing_time_ms",
        ),
    }
    return {name: df.to(spark_schema(name)) for name, df in tables.items()}


def spark_schema(table: str) -> StructType:
    return StructType.fromDDL(getattr(schemas, table.upper()))


def append(results: DataFrame, folder: str, key: str | None = None) -> bool:
    """Appends the five result tables of evaluated scans below folder, all or none: a header is never without its details.
    The results are computed once, for all five. A batch that is repeated under its key leaves its rows once. An error goes
    to the caller."""
    return append_batch(detail_tables(stored(results, "results")), folder, key or uuid.uuid4().hex)


def with_details(header: DataFrame, **details: DataFrame) -> DataFrame:
    """header with an array column for each table of details, in no order; empty where a scan has none."""
    for name, rows in details.items():
        own = rows.groupBy("scan_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "scan_id"))).alias(name))
        header = header.join(own, "scan_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return header


def history(records: DataFrame, limit: int | None = None, context: RunContext = RunContext()) -> DataFrame:
    """The latest scans, as many as asked for and at most context.history_most. The order is total, so ties are settled by id."""
    wanted = context.history_default if limit is None else limit
    rows = records.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(max(0, min(wanted, context.history_most)))
    found = F.coalesce("reference_product_id", F.lit("")) != ""
    return rows.select(F.col("scan_id").cast("string").alias("scan_id"), "created_at", F.coalesce("detected_product_name", F.lit("")).alias("product_name"), found.alias("reference_found"), F.col("status").alias("compliance_status"))
