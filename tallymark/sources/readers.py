"""Sources: JSON catalogues, tables, uploads and images."""

from __future__ import annotations

import warnings

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..context import RunContext

#: Error codes of uploads that cannot be used.
EMPTY, TOO_LARGE, INVALID = "EMPTY_UPLOAD", "IMAGE_TOO_LARGE", "INVALID_IMAGE"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file; an absent file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def positioned(df: DataFrame, name: str) -> DataFrame:
    """df with a column of its rows' places in the file. One small file, so ids run on from 0."""
    return df.withColumn(name, F.monotonically_increasing_id())


def products_json(spark: SparkSession, path: str) -> DataFrame:
    return positioned(json_rows(spark, path, schemas.PRODUCTS), "catalogue_pos")


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    return positioned(json_rows(spark, path, schemas.RULES), "rule_pos")


def products(spark: SparkSession, table: str | None, seed_path: str) -> DataFrame:
    """The catalogue table, or the seed file where there is none or it cannot be read (a warning says so)."""
    if table:
        try:
            found = spark.table(table)
            found.limit(1).collect()
            return found
        except PySparkException as error:
            warnings.warn(f"catalogue {table} cannot be read, the seed file is used: {str(error)[:200]}", stacklevel=2)
    return products_json(spark, seed_path)


def uploads(spark: SparkSession, path: str, context: RunContext = RunContext()) -> DataFrame:
    """Files below path: path, name, length, sha256, content and error_code (null for usable ones)."""
    from ..functions.text import safe_file_name

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    error = F.when(F.col("length") == 0, EMPTY).when(F.col("length") > context.max_upload_bytes, TOO_LARGE)
    name = safe_file_name(F.regexp_extract("path", r"([^/]*)$", 1))
    return files.select("path", name.alias("name"), "length", F.sha2("content", 256).alias("sha256"), "content", error.alias("error_code"))


def images(spark: SparkSession, path: str, context: RunContext = RunContext()) -> DataFrame:
    """Decoded images: path, height, width, channels, data (blue, green, red) and error_code. Corrupt files stay as rows
    with an error."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    small = F.least("height", "width") < context.min_side
    large = F.col("height").cast("long") * F.col("width") > context.max_pixels
    error = F.when((F.col("height") <= 0) | small | large, INVALID)
    return i.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data", error.alias("error_code"))


def stored_name(content: Column, name: Column, bucket: str) -> Column:
    """Where an original is kept: by the hash of its bytes, so a second write changes nothing."""
    return F.concat(F.lit(f"local://{bucket}/"), F.sha2(content, 256), F.lit("/"), name)
