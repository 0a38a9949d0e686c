"""Sends this package to the Python workers, as spark-submit --py-files would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    context = spark.sparkContext
    if any("tallymark-base" in name for name in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tallymark-")) / "tallymark-base.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("tallymark") / path.relative_to(root))
    context.addPyFile(str(archive))
