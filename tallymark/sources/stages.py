"""Stages of a bulk run: each is timed, its rows are counted while they are written, and a failure is a row that tells why."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh
from .sinks import append_batch

INTERNAL = "INTERNAL_ERROR"
#: The code of an error in each stage.
CODES = {
    "upload": "INVALID_IMAGE", "ocr": "OCR_PROCESSING_ERROR", "barcode": "BARCODE_PROCESSING_ERROR", "tampering": "TAMPERING_PROCESSING_ERROR", "product_matching": "REFERENCE_LOOKUP_ERROR",
    "reference_comparison": "REFERENCE_LOOKUP_ERROR", "compliance_engine": "COMPLIANCE_ENGINE_ERROR", "storage": "STORAGE_ERROR", "persist_results": "DATABASE_ERROR",
}
SCHEMA = "run string, pos int, stage string, status string, rows long, duration_ms long, error_code string, error string"
#: Signs of an error's text that are kept.
ERROR_TEXT = 2000


class Stages:
    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run, self.rows = spark, run, []

    def note(self, stage: str, began: float, rows: int | None, error: Exception | None) -> None:
        code = CODES.get(stage, INTERNAL) if error else None
        text = str(error)[:ERROR_TEXT] if error else None
        self.rows.append((self.run, len(self.rows), stage, "failed" if error else "success", rows, int((time.monotonic() - began) * 1000), code, text))

    def stored(self, stage: str, made: Callable[[], DataFrame], instead: Callable[[], DataFrame] | None = None) -> DataFrame:
        """made(), written to the shared folder and read back. If that fails and there is something to use instead, the run
        goes on with it; else the error goes to the caller, who finds it among the rows as well."""
        began, seen, path = time.monotonic(), Observation(f"{stage} of {self.run}"), fresh(self.spark, stage)
        try:
            df = made()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        except Exception as error:  # isolation of a stage: the row tells what went wrong
            self.note(stage, began, None, error)
            if instead is None:
                raise
            return self.stored(f"{stage}_fallback", instead)
        self.note(stage, began, seen.get["rows"], None)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self, stage: str, act: Callable[[], object]) -> bool:
        """Whether act went well; its error is a row."""
        began = time.monotonic()
        try:
            act()
        except Exception as error:
            self.note(stage, began, None, error)
            return False
        self.note(stage, began, None, None)
        return True

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def append(self, folder: str) -> bool:
        """Adds the rows to the table stage_metrics below folder, once for each run."""
        return append_batch({"stage_metrics": self.table()}, f"{folder}/metrics", self.run)
