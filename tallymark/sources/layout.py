"""Tables laid out for their readers: bucketed by scan for joins of headers and details, partitioned by day for the latest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh

BUCKETS = 64


def bucketed(rows: DataFrame, name: str, key: str = "scan_id", buckets: int = BUCKETS) -> DataFrame:
    """rows as a stored table in buckets of key, sorted within: joins and groupings by key of tables with as many buckets
    need no shuffle. The files are below the shared folder, the table's name in the session's catalogue is its own."""
    own = f"tm_{name}_{uuid.uuid4().hex}"
    spread = rows.repartition(buckets, key)  # a file a bucket
    spread.write.bucketBy(buckets, key).sortBy(key).option("path", fresh(rows.sparkSession, name)).format("parquet").saveAsTable(own)
    return rows.sparkSession.table(own)


def by_day(rows: DataFrame, name: str, time: str = "created_at") -> str:
    """Path of rows stored in a partition for each day of time."""
    path = fresh(rows.sparkSession, name)
    rows.withColumn("day", F.to_date(time)).repartition("day").write.partitionBy("day").parquet(path)
    return path


def days(spark: SparkSession, path: str) -> list[str]:
    """The days that have a partition, the latest first: names of folders, no rows are read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    return sorted((n[4:] for n in names if n.startswith("day=") and n != "day=__HIVE_DEFAULT_PARTITION__"), reverse=True)


def latest(spark: SparkSession, path: str, wanted: int) -> DataFrame:
    """Rows of the latest days, at least wanted if there are as many: all rows of 1, 2, 4, ... days until they suffice, so
    what is read grows with wanted and not with the table. Rows without a day come last, with all others."""
    found, n, rows = days(spark, path), 1, spark.read.parquet(path)
    while n < len(found):
        part = rows.where(F.col("day").isin(*(F.lit(d).cast("date") for d in found[:n])))
        if part.count() >= wanted:
            return part
        n *= 2
    return rows
