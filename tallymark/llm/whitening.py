"""Whitening of embeddings from an exact scatter (operator 12).

Each entry c becomes the whole number x = floor(1024 c) + 100000. The scatter of the x-vectors, with a column of ones that
brings sums and count along, is taken in a residue number system: every partition multiplies its residues modulo several
primes below 2**20 (products of STEP rows stay below 2**53, so double GEMMs are exact), and Spark adds the residues up by
prime and cell. Chinese remaindering gives the exact sums; as many primes are used as the largest entry and the number of
rows need. n times the scatter less the products of the sums is n**2 times the covariance, still in whole numbers; only
then is it divided into doubles and decomposed by eigh, twice: the second time in the basis found first, which takes off
what rounding left.

To the driver come one row of statistics and, for d dimensions, d**2 / 2 residues a prime, whatever the number of rows.

Defined results: rows whose vector is null, empty, or holds null, non-finite entries or entries of 2**52 and beyond (whose x
no long can hold) are dropped, and so are vectors of another length than most have; null and repeated vec_ids are rows
like any others; ties of eigenvalues keep the order of eigh; the entry of a component that is largest in size is positive;
a component without variance (as with one row, or equal rows) cannot be whitened and gives no rows; a deviation beyond 38
digits is null; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, matrix, usual_length

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of one exact product of residues, and the bound of primes: STEP * PRIMES_BELOW ** 2 <= 2 ** 53.
STEP, PRIMES_BELOW = 1 << 13, 1 << 20
LARGEST = float(2**52)


def primes(most: int) -> list[int]:
    """The largest primes below PRIMES_BELOW whose product is over most."""
    found: list[int] = []
    candidate = PRIMES_BELOW - 1
    while not found or prod(found) <= most:
        if all(candidate % k for k in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
        candidate -= 2
    return found


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64) + SHIFT


def upper(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def scatter_residues(rows: DataFrame, d: int, moduli: list[int]) -> DataFrame:
    """prime, cell, residue: the scatter of (x, 1) over all rows, summed by prime and cell of the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        seen = 0
        for batch in batches:
            x = whole(matrix(batch.column(0), d))
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            seen += len(x)
            for k, p in enumerate(moduli):
                residues = (x % p).astype(np.float64)
                for start in range(0, len(x), STEP):
                    part = residues[start : start + STEP]
                    sums[k] = (sums[k] + (part.T @ part).astype(np.int64)) % p
        if seen:
            i, j = upper(d + 1)
            cells = np.arange(len(i))
            for k, p in enumerate(moduli):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(cells), pa.array(sums[k][i, j])], names=["prime", "cell", "residue"])

    return rows.select("tm_vector").mapInArrow(run, "prime long, cell long, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))


def reconstructed(residues: pa.Table, d: int, moduli: list[int]) -> np.ndarray:
    """The exact whole numbers of the upper triangle, by Chinese remaindering into the range around zero."""
    whole_product, i = prod(moduli), upper(d + 1)[0]
    total = np.zeros(len(i), object)
    for p in moduli:
        own = residues.filter(pa.compute.equal(residues.column("prime"), p))
        rest = whole_product // p
        weight = rest * pow(rest, -1, p)
        value = (own.column("residue").to_numpy() % p).astype(object) * weight
        total[own.column("cell").to_numpy()] += value
    total %= whole_product
    return np.where(total > whole_product // 2, total - whole_product, total)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    #: Columns are components scaled by one over the root of their eigenvalue.
    projection: np.ndarray
    explained: np.ndarray
    #: Largest absolute entry of an x.
    most: int

    @property
    def components(self) -> int:
        return self.projection.shape[1]

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in 64 bits if they suffice, else as Python numbers."""
        wide = 2 * self.n * self.most >= 2**62
        return x.astype(object if wide else np.int64) * self.n - np.array(self.sums, object if wide else np.int64)

    def deviations(self, offsets: np.ndarray) -> pa.Array:
        digits = pa.decimal128(38, 0)
        if offsets.dtype != object and offsets.shape[1] * (2 * self.n * self.most) ** 2 < 2**63:
            return pa.array((offsets * offsets).sum(axis=1), pa.int64()).cast(digits)
        squares = (offsets.astype(object) ** 2).sum(axis=1)
        return pa.array([s if s < 10**38 else None for s in squares], digits)

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets / self.n).astype(np.float64) @ self.projection


def decomposed(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and unit eigenvectors as columns, their largest entries positive."""
    basis = np.linalg.eigh(covariance)[1]
    turned = basis.T @ covariance @ basis
    values, turn = np.linalg.eigh((turned + turned.T) / 2)
    vectors = (basis @ turn)[:, ::-1]
    vectors /= np.linalg.norm(vectors, axis=0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values[::-1], vectors * np.where(largest < 0, -1.0, 1.0)


def vectors_of(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """rows with tm_vector, those that take part, and the number of dimensions."""
    good = finite(rows, column).where(F.forall(column, lambda x: F.abs(x) < LARGEST))
    d = usual_length(good, column)
    return good.where(F.size(column) == d).withColumn("tm_vector", F.col(column).cast("array<double>")), d


def fitted(good: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of good's tm_vector; None without rows."""
    ends = good.agg(F.count("*").alias("n"), F.min(F.array_min("tm_vector")).alias("low"), F.max(F.array_max("tm_vector")).alias("high")).first()
    if not ends["n"]:
        return None
    most = int(max(np.abs(whole(np.array([ends["low"], ends["high"]]))).max(), 1))
    moduli = primes(2 * ends["n"] * most * most + 1)
    cells = reconstructed(scatter_residues(good, d, moduli).toArrow(), d, moduli)
    table = np.zeros((d + 1, d + 1), object)
    table[upper(d + 1)] = cells
    n, sums = int(table[d, d]), table[:d, d]
    exact = n * table[:d, :d] - np.outer(sums, sums)
    covariance = np.array([[exact[min(i, j), max(i, j)] / (n * n) for j in range(d)] for i in range(d)], np.float64)
    trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
    values, vectors = decomposed(covariance)
    values, vectors = values[:components], vectors[:, :components]
    varied = values > trace * d * np.finfo(np.float64).eps
    values, vectors = values[varied], vectors[:, varied]
    return Whitening(n, tuple(map(int, sums)), vectors / np.sqrt(values), values / trace if trace else values, most)


def identity_error(good: DataFrame, d: int, fit: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows, as they come out, less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((fit.components + 1, fit.components + 1))
        for batch in batches:
            z = fit.whitened(fit.offsets(whole(matrix(batch.column(0), d))))
            z = np.hstack([z, np.ones((len(z), 1))])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    sums = good.select("tm_vector").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((fit.components + 1) ** 2)
    total[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    total = total.reshape(fit.components + 1, -1) / fit.n
    mean = total[:-1, -1]  # zero but for rounding, as rows are centred exactly
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(fit.components)).max(initial=0.0))


def whitened(rows: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error for each row and component."""
    good, d = vectors_of(rows.select(key, column), column)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fitted(good, d, components)
    if fit is None or not fit.components:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(good, d, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.components
        for batch in batches:
            offsets = fit.offsets(whole(matrix(batch.column(1), d)))
            m = len(offsets)
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n, np.int64)), fit.deviations(offsets).take(again),
                    pa.array(fit.whitened(offsets).ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.select(key, "tm_vector").mapInArrow(run, schema)
