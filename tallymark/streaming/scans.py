"""A stream of label texts through the batch plan, appended to the result tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..context import RunContext
from ..plans.pipeline import evaluate
from ..sources.commits import Log
from ..sources.sinks import append_batch, detail_tables
from ..storage import scratch, stored

SCANS = "scan_id long, created_at timestamp, ocr_status string, text string, zoom_text string, barcode string, tampering_status string, tampering_score double"


def high_water(spark: SparkSession, out: str, before: str) -> datetime.datetime | None:
    """The latest created_at of the batches committed before the one named so."""
    seen = []
    for entry in Log(spark, f"{out}/commits").entries():
        if entry["key"] == before:
            break
        if entry.get("high"):
            seen.append(datetime.datetime.fromisoformat(entry["high"]))
    return max(seen, default=None)


def add(batch: DataFrame, number: int, products: DataFrame, rules: DataFrame, out: str, late: datetime.timedelta | None, context: RunContext) -> bool:
    """Evaluates one batch and commits it. Scans that are older by more than late than the latest scan of earlier batches go
    to the table late_scans as they are, in the same commit; evaluating them is up to who looks after that table."""
    spark, key = batch.sparkSession, f"stream-{number}"
    with scratch(spark):  # a stream has no end, so what its batches store must have one
        return settled(stored(batch, "batch"), key, products, rules, out, late, context)


def settled(rows: DataFrame, key: str, products: DataFrame, rules: DataFrame, out: str, late: datetime.timedelta | None, context: RunContext) -> bool:
    spark = rows.sparkSession
    high = high_water(spark, out, key)
    behind = F.lit(False) if late is None or high is None else F.coalesce(F.col("created_at") < F.lit(high - late), F.lit(False))
    rows = rows.withColumn("tm_late", behind)
    latest = rows.agg(F.max("created_at")).first()[0]
    results = stored(evaluate(rows.where("not tm_late").drop("tm_late"), products, rules, context), "results")
    tables = detail_tables(results) | ({"late_scans": rows.where("tm_late").drop("tm_late")} if late is not None else {})
    return append_batch(tables, out, key, high=latest and latest.isoformat())


def start(spark: SparkSession, folder: str, products: DataFrame, rules: DataFrame, out: str, checkpoint: str, context: RunContext = RunContext(), late: datetime.timedelta | None = None) -> StreamingQuery:
    """Evaluates JSON files of scans as they arrive in folder. A batch is committed to all tables at once, and one that is
    repeated after a failure adds nothing if it was committed (see sinks.append_batch)."""
    scans = spark.readStream.schema(SCANS).json(folder)
    write = lambda batch, number: add(batch, number, products, rules, out, late, context)
    return scans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
