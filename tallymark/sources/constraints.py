"""Constraints of the tables, audited in bulk or while a batch is written.

Column constraints (NOT NULL, CHECK) of a table are conditions on its rows, all counted in one scan. Uniqueness and foreign
keys need the keys together: keys are counted first, one row a key, so a key that many rows hold stays one row in the
shuffle, and what has no partner is left by an anti-join of distinct keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import SEVERITIES


@dataclass(frozen=True)
class Constraint:
    table: str
    column: str
    kind: str  # not_null, check, unique or foreign
    values: tuple[str, ...] = ()  # of a check: what the column may be beside null
    parent: tuple[str, str] = ("", "")  # of a foreign key: table and column

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}:{self.kind}"

    @property
    def violated(self) -> Column:
        """Whether a row breaks a not_null or check constraint; a null passes checks."""
        c = F.col(self.column)
        return c.isNull() if self.kind == "not_null" else F.coalesce(~c.isin(*self.values), F.lit(False))


DETAILS = ("ocr_results", "barcode_results", "tampering_results", "compliance_results")
#: The constraints of the eight tables.
CONSTRAINTS = (
    *(Constraint("product_reference", c, "not_null") for c in ("reference_product_id", "brand", "product_name")),
    Constraint("product_reference", "reference_product_id", "unique"),
    *(Constraint("compliance_rules", c, "not_null") for c in ("rule_code", "rule_name", "operator", "severity", "is_active")),
    Constraint("compliance_rules", "severity", "check", SEVERITIES),
    Constraint("nutrition_ocr_raw", "is_reference", "not_null"),
    Constraint("scan_records", "scan_id", "not_null"),
    Constraint("scan_records", "scan_id", "unique"),
    *(Constraint(t, "scan_id", "foreign", parent=("scan_records", "scan_id")) for t in DETAILS),
    Constraint("barcode_results", "detected", "not_null"),
    Constraint("compliance_results", "overall_status", "check", ("compliant", "non_compliant", "review_required", "processing", "failed")),
    Constraint("compliance_results", "risk_level", "check", SEVERITIES),
)


def of_rows(constraints: Iterable[Constraint], table: str) -> list[Constraint]:
    return [c for c in constraints if c.table == table and c.kind in ("not_null", "check")]


def keyed(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("tm_key")).agg(F.count("*").alias("tm_n"))


def audit(tables: dict[str, DataFrame], constraints: Iterable[Constraint] = CONSTRAINTS) -> DataFrame:
    """table_name, constraint_name, kind, rows and violations for each constraint on a table at hand. Of a unique key all rows
    but one a key count, of a foreign key all rows whose key the parent lacks; nulls are neither. Columns that a table
    does not have are not audited, nor foreign keys to tables that are not at hand."""
    constraints = [c for c in constraints if c.table in tables and c.column in tables[c.table].columns]
    parts: list[DataFrame] = []
    shown = lambda c, rows, violations: F.struct(F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"), F.lit(c.kind).alias("kind"), rows.alias("rows"), F.coalesce(violations, F.lit(0)).cast("long").alias("violations"))
    for name, rows in tables.items():
        if own := of_rows(constraints, name):
            counts = rows.agg(F.count("*").alias("tm_rows"), *(F.count_if(c.violated).alias(f"tm_{k}") for k, c in enumerate(own)))
            parts.append(counts.select(F.inline(F.array(*(shown(c, F.col("tm_rows"), F.col(f"tm_{k}")) for k, c in enumerate(own))))))
    for c in constraints:
        keys = keyed(tables[c.table], c.column) if c.kind in ("unique", "foreign") else None
        if c.kind == "unique":
            sums = keys.agg(F.coalesce(F.sum("tm_n"), F.lit(0)).alias("tm_rows"), F.sum(F.col("tm_n") - 1).alias("tm_bad"))
            parts.append(sums.select(F.inline(F.array(shown(c, F.col("tm_rows"), F.col("tm_bad"))))))
        elif c.kind == "foreign" and c.parent[0] in tables:
            parent = tables[c.parent[0]].select(F.col(c.parent[1]).alias("tm_key")).distinct()
            lone = keys.join(parent.withColumn("tm_known", F.lit(True)), "tm_key", "left")
            sums = lone.agg(F.coalesce(F.sum("tm_n"), F.lit(0)).alias("tm_rows"), F.sum(F.when(F.col("tm_known").isNull(), F.col("tm_n"))).alias("tm_bad"))
            parts.append(sums.select(F.inline(F.array(shown(c, F.col("tm_rows"), F.col("tm_bad"))))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class ConstraintError(ValueError):
    """Rows that break constraints; the batch that holds them is not committed."""


class Guard:
    """Counts violations of a table's row constraints while the table is written, without a scan of its own."""

    def __init__(self, table: str, constraints: Iterable[Constraint] = CONSTRAINTS):
        self.table, self.constraints = table, of_rows(constraints, table)
        self.seen: Observation | None = None

    def watch(self, rows: DataFrame) -> DataFrame:
        self.constraints = [c for c in self.constraints if c.column in rows.columns]
        if not self.constraints:
            return rows
        self.seen = Observation(f"constraints of {self.table}")
        return rows.observe(self.seen, *(F.count_if(c.violated).alias(str(k)) for k, c in enumerate(self.constraints)))

    def settle(self) -> None:
        """After the write: raises if rows broke a constraint."""
        counts = self.seen.get if self.seen else {}
        broken = [f"{c.name} ({counts[str(k)]} rows)" for k, c in enumerate(self.constraints) if counts.get(str(k))]
        if broken:
            raise ConstraintError(f"not committed: {', '.join(broken)}")
