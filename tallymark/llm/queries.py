"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .collocations import collocations
from .common import documents, ship
from .fingerprints import fingerprints
from .line_dedup import line_dedup
from .mixing import Mix, mixed
from .neighbours import nearest_rows
from .pii import personal_data
from .quality import quality_verdicts
from .secret_scan import secrets
from .sharding import sharded
from .simhash import near_duplicates
from .token_files import token_files
from .whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers f under its name; the workers get this package first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), 40)


def domain() -> Column:
    """Domains by the number of a document's source."""
    return F.concat(F.lit("d"), F.floor(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") / 5).cast("string"))


MIX = Mix(weights={"domain": {"d0": 4.0, "d1": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}, "source": {"src0": 2.0}})


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir).withColumn("domain", domain()), MIX).drop("tm_text")


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(embeddings(spark, sf_dir)).withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(embeddings(spark, sf_dir))
