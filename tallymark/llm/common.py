"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import importlib.util
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also when lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest60(text: Column) -> Column:
    """First 60 bits of the MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def text_id(text: Column) -> Column:
    """Digest of a text; null counts as empty."""
    return digest60(F.coalesce(text, F.lit("")))


#: Values that hold more than one in HOT of the rows of a join are spread over several tasks.
HOT = 2000
#: Values with fewer rows than this never burden a task.
FEW = 500


def spread_join(left: DataFrame, right: DataFrame, on: str, sizes: DataFrame, by: Column) -> DataFrame:
    """left joined with right on a column some of whose values may hold a large part of left.

    sizes: (on, tm_rows) with one row for each value of right, tm_rows counting the rows of left that hold it. A value
    with more than one in HOT of all these rows is dealt over as many salts as it holds such parts, left by the hash
    ``by``, right once for each salt. At most HOT values can be that hot; these come to the driver. Usually none is.
    """
    total = sizes.agg(F.sum("tm_rows").alias("tm_total"))
    hot = sizes.join(F.broadcast(total)).where((F.col("tm_rows") >= FEW) & (F.col("tm_rows") * HOT > F.col("tm_total")))  # total is one row
    hot = hot.select(on, F.ceil(F.col("tm_rows") * HOT / F.col("tm_total")).cast("int").alias("tm_salts"))
    rows = hot.collect()
    if not rows:
        return left.join(right, on)
    hot, salts = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema)), F.coalesce("tm_salts", F.lit(1))
    one = left.join(hot, on, "left").withColumn("tm_salt", F.pmod(by, salts).cast("int")).drop("tm_salts")
    many = right.join(hot, on, "left").withColumn("tm_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("tm_salts")
    return one.join(many, [on, "tm_salt"]).drop("tm_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. Only a local master, where all is one
    process, gets a temporary folder if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if any("tallymark-code" in name for name in context.listFiles):
        return
    root = Path(importlib.util.find_spec("tallymark").origin).parent
    archive = Path(tempfile.mkdtemp(prefix="tallymark-")) / "tallymark-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("tallymark") / path.relative_to(root))
    context.addPyFile(str(archive))
