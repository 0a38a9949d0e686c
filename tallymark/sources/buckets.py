"""A keyed table in buckets of its keys' hashes: an upsert writes only the buckets that it touches.

A version of the table is an entry of its log, which names the folder of each bucket. A new version names new folders for the
touched buckets and the old ones for the rest, so readers of any version see whole tables and untouched files stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Log
from .sinks import upsert as merged

#: Buckets of a new table; an existing table keeps its number.
BUCKETS = 64


def log(spark: SparkSession, folder: str) -> Log:
    return Log(spark, f"{folder}/versions")


def version(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The entry of a version, the latest by default; None for a table that is not there."""
    entries = log(spark, folder).entries()
    return next((e for e in reversed(entries) if number is None or e["version"] == number), None)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The table as of a version. The bucket column is the folders' and is left out."""
    entry = version(spark, folder, number)
    if entry is None:
        raise ValueError(f"no table in {folder}")
    return spark.read.schema(entry["schema"]).parquet(*sorted(f"{folder}/{p}" for p in entry["buckets"].values()))


def upsert(source: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> dict:
    """Puts source's rows in by key and commits a new version, whose entry is returned; an absent table is made of them. A
    null in source leaves the column as it was; source has unique keys. If another writer commits first, the merge is done
    again on its version."""
    spark = source.sparkSession
    place = lambda n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")

    def next_version(before: list[dict]) -> dict:
        last = before[-1] if before else {"number": buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "buckets": {}}
        rows = source.withColumn("tm_bucket", place(last["number"]))
        touched = [str(r[0]) for r in rows.select("tm_bucket").distinct().collect()]  # as many as there are buckets at most
        old = [f"{folder}/{last['buckets'][b]}" for b in touched if b in last["buckets"]]
        target = spark.read.schema(last["schema"]).parquet(*old) if old else spark.createDataFrame([], last["schema"])
        new = f"data/{uuid.uuid4().hex}"
        both = merged(target, source.select(target.columns), key).withColumn("tm_bucket", place(last["number"]))
        both.repartition("tm_bucket").write.partitionBy("tm_bucket").parquet(f"{folder}/{new}")
        return {"number": last["number"], "schema": last["schema"], "buckets": last["buckets"] | {b: f"{new}/tm_bucket={b}" for b in touched}}

    return log(spark, folder).add(next_version)
