"""Rows of vectors that take part in an operator, shared by operators 12 and 13."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector holds finite numbers only. Null vectors, empty ones and such with null entries are none of them."""
    big = F.lit(float("inf"))
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
    return rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & good)


def usual_length(rows: DataFrame, column: str) -> int:
    """The length that most vectors have, the larger of equals; 0 if there are none."""
    found = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
