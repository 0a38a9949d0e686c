"""Registry of the queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.queries import ORACLE, QUERIES

FLAGSHIP, SMALLEST = "scan_full", "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, SMALLEST)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
