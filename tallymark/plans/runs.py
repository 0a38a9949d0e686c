"""A bulk run of scans in stages: fields, products and comparisons, rules, tables. Each stage is stored, counted and timed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..operators import rules as rule_ops
from ..sources import sinks
from ..sources.stages import Stages
from . import pipeline


def run(scans: DataFrame, products: DataFrame, rules: DataFrame, name: str, folder: str | None = None, context: RunContext = RunContext(), fuzzy: bool = True) -> tuple[DataFrame, Stages]:
    """The results of scans and the stages they went through. A catalogue that cannot be read leaves scans without a
    reference product, as a product that is not in it does. With a folder, results and stages are appended there, once
    for each name; a failure of that is a stage like others."""
    stages = Stages(scans.sparkSession, name)
    none = scans.sparkSession.createDataFrame([], products.schema)
    read = stages.stored("field_extraction", lambda: pipeline.fields(scans, products, context), lambda: pipeline.fields(scans, none, context))
    seen = stages.stored("product_matching", lambda: pipeline.compared(read, products, fuzzy), lambda: pipeline.compared(read, none, False))
    results = stages.stored("compliance_engine", lambda: rule_ops.folded(rule_ops.judged(seen, rule_ops.active(rules, F.lit(context.as_of)))).drop("presence"))
    if folder is not None:
        stages.done("persist_results", lambda: sinks.append_batch(sinks.detail_tables(results), folder, name))
        stages.append(folder)
    return results, stages
