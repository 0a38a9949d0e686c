"""Nearest neighbours by multi-index hashing (operator 13).

Rotations are learned from a bounded sample: principal axes, then an orthogonal turn that brings the entries' signs closest
to the entries (alternating least squares), ROTATIONS times from different starts. The signs of a turned vector are its
binary code, 64 bits or fewer a rotation. Every row gets its code and is stored; codes are split into substrings of PIECE
bits, and each block of rows indexes every substring: its distinct values with the rows that hold them.

A search goes through the radii upwards. If a code lies within t + 1 times the number of substrings, less one, then one of
its substrings lies within t of the query's (pigeonhole), so at step t each substring's entries at distance t are looked
up, and all codes within that radius have been seen. Those within it are compared on the original vectors. A query
goes on until K rows are found and the radius covers the codes of all rows that may be nearer than its K-th: an upper bound
of the code distance at that Euclidean distance, learned from the sample's neighbours. RECALL of the sample's neighbours
lie within the largest radius; a query leaves off there once it has K rows.

Queries are dealt to all blocks of rows; each task holds one block of rows (BLOCK_BYTES) and one of queries, and gives at
most K rows a query, of which a window keeps the K nearest. A block's own K-th is no nearer than that of all rows, so
smaller blocks can only find more.

Defined results: a null vec_id, and a vector that is null, empty, zero, of another length than most, or holds null or
non-finite entries, takes no part; equal rows are rows of their own, so a copy of the query's row is a candidate; ties go
to the smaller vec_id; a table with fewer candidates than K gives them all; an empty one gives nothing; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import finite, matrix, usual_length

K, EVERY = 10, 100
#: The sample's rows at most (and entries at most), its queries, and the share of its neighbours that the radius covers.
SAMPLE, SAMPLE_ENTRIES, SAMPLE_QUERIES, RECALL = 20_000, 4_000_000, 500, 0.98
ROTATIONS, ROUNDS, PIECE = 4, 25, 16
#: Bytes of the vectors of one block, and its rows at least, as smaller ones repeat the queries more often.
BLOCK_BYTES, BLOCK_LEAST = 1 << 26, 1 << 12


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    #: Turns vectors into the entries whose signs are the bits; each rotation's columns side by side.
    turn: np.ndarray
    #: Bits of a rotation, which fill words of 64.
    bits: int
    radius: int = 0
    #: Code distance of near rows for each unit of Euclidean distance.
    slope: float = 0.0

    @property
    def words(self) -> int:
        return self.turn.shape[1] // self.bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of unsigned 64-bit words."""
        signs = ((vectors - self.mean) @ self.turn > 0).reshape(len(vectors), self.words, self.bits)
        wide = np.zeros((len(vectors), self.words, 64), bool)
        wide[:, :, : self.bits] = signs
        return np.packbits(wide, axis=2, bitorder="little").view("<u8").reshape(len(vectors), self.words)

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """An upper bound of the code distance of rows at that distance: the usual one and three deviations."""
        usual = self.slope * distance
        return np.minimum(self.radius, np.ceil(usual + 3 * np.sqrt(usual)))


def code_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def euclidean(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def learned(sample: np.ndarray, seed: int = 0) -> Codes:
    """Rotations from the sample, and the radius that covers RECALL of its neighbours' codes."""
    random = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(64, sample.shape[1])
    axes = np.linalg.eigh(centred.T @ centred / len(sample))[1][:, ::-1][:, :bits]
    entries = centred @ axes
    turns = []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(random.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(entries @ turn > 0, 1.0, -1.0).T @ entries)
            turn = (left @ right).T
        turns.append(axes @ turn)
    codes = Codes(mean, np.hstack(turns), bits)
    own = codes.of(sample)
    far, near = [], []
    for q in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        distance = euclidean(sample, sample[q])
        distance[q] = np.inf
        first = np.argpartition(distance, min(K, len(sample) - 1))[:K]
        first = first[np.isfinite(distance[first])]
        far.append(code_distance(own[first], own[q]))
        near.append(distance[first])
    far, near = np.concatenate(far), np.concatenate(near)
    if not len(far):
        return codes
    return Codes(mean, codes.turn, bits, int(np.ceil(np.quantile(far, RECALL))), float(far.sum() / max(near.sum(), 1e-300)))


class Index:
    """The substrings of one block's codes: for each its distinct values in order, and the rows of each value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        pieces = codes.view("<u2").reshape(len(codes), -1)
        self.pieces = []
        for k in range(pieces.shape[1]):
            order = np.argsort(pieces[:, k], kind="stable").astype(np.int32)
            values, starts = np.unique(pieces[order, k], return_index=True)
            self.pieces.append((values, order, starts, np.append(starts[1:], len(order))))

    def steps(self, query: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For t = 0, 1, ...: the radius within which all codes have then been seen, and the rows first seen at t."""
        own = query.view("<u2")
        apart = [np.bitwise_count(values ^ own[k]) for k, (values, *_) in enumerate(self.pieces)]
        seen = np.zeros(len(self.codes), bool)
        for t in range(PIECE + 1):
            before = seen.copy()
            for distance, (_, order, starts, ends) in zip(apart, self.pieces):
                hit = np.flatnonzero(distance == t)
                sizes = ends[hit] - starts[hit]
                at = np.repeat(starts[hit] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
                seen[order[at]] = True
            yield len(self.pieces) * (t + 1) - 1, np.flatnonzero(seen & ~before)


def nearest(index: Index, vectors: np.ndarray, names: np.ndarray, rows: np.ndarray, query: np.ndarray, code: np.ndarray, own_row: int, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of a block that the search finds."""
    at, distances, waiting = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    apart = np.zeros(0, np.int32)
    for radius, new in index.steps(code):
        waiting = np.append(waiting, new)
        apart = np.append(apart, code_distance(index.codes[new], code))
        within = radius if len(at) < k else min(radius, int(codes.reach(distances[k - 1])))
        ready = apart <= within
        found = waiting[ready]
        found = found[rows[found] != own_row]
        waiting, apart = waiting[~ready], apart[~ready]
        if len(found):
            at = np.append(at, found)
            distances = np.append(distances, euclidean(vectors[found].astype(np.float64), query))
            order = np.lexsort((names[at], distances))[:k]
            at, distances = at[order], distances[order]
        if len(at) >= k and radius >= codes.reach(distances[k - 1]):
            break
    return at, distances


def is_query(key: Column, every: int = EVERY) -> Column:
    return key % every == 0


def prepared(rows: DataFrame, column: str, key: str) -> tuple[DataFrame, int]:
    """key, tm_vector of the rows that take part, and the number of dimensions."""
    good = finite(rows.select(key, column), column).where(F.col(key).isNotNull() & F.exists(column, lambda x: x != 0))
    d = usual_length(good, column)
    return good.where(F.size(column) == d).select(key, F.col(column).alias("tm_vector")), d


def sampled(good: DataFrame, key: str, d: int) -> np.ndarray:
    """The vectors of SAMPLE rows at most, those of the smallest hashes."""
    most = min(SAMPLE, max(1, SAMPLE_ENTRIES // d))
    rows = good.orderBy(F.xxhash64(key, "tm_vector"), key).limit(most).select(F.col("tm_vector").cast("array<double>").alias("v")).toArrow()
    return np.vstack([matrix(part, d) for part in rows.column("v").chunks if len(part)])


def indexed(good: DataFrame, key: str, d: int, codes: Codes) -> DataFrame:
    """key, tm_vector, tm_code, tm_row of every row, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codes.of(matrix(batch.column(1), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in made], pa.binary())], names=[key, "tm_vector", "tm_code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema.fields)
    return stored(good.mapInArrow(run, f"{fields}, tm_code binary").withColumn("tm_row", F.monotonically_increasing_id()), "codes")


def nearest_rows(rows: DataFrame, k: int = K, every: int = EVERY, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row whose key is divisible by every."""
    good, d = prepared(rows, column, key)
    schema = "tm_query long, query_id long, vec_id long, score double, tm_row long"
    if not d:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = learned(sampled(good, key, d))
    table = indexed(good, key, d, codes).select(F.col(key).cast("long").alias("tm_name"), "tm_vector", "tm_code", "tm_row")
    asking = table.where(is_query(F.col("tm_name"), every))
    sizes = table.agg(F.count("*").alias("rows"), F.count_if(is_query(F.col("tm_name"), every)).alias("asking")).first()
    most = max(BLOCK_LEAST, BLOCK_BYTES // (8 * d))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-sizes["rows"] // most), min(cores, -(-sizes["rows"] // BLOCK_LEAST)), 1)
    turns = max(-(-sizes["asking"] // most), 1)
    dealt = lambda n, seed: F.pmod(F.xxhash64("tm_row", F.lit(seed)), F.lit(n))
    whole = table.select("*", dealt(blocks, 1).alias("tm_block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("tm_turn"))
    asked = asking.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("tm_block"), dealt(turns, 2).cast("int").alias("tm_turn"))
    keys, parts = ["tm_block", "tm_turn"], blocks * turns

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        def part(t: pa.Table) -> tuple[np.ndarray, ...]:
            t = t.combine_chunks()
            vectors = t.column("tm_vector").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            words = np.frombuffer(b"".join(t.column("tm_code").to_pylist()), "<u8").reshape(len(vectors), -1)
            return vectors, words, t.column("tm_name").to_numpy(), t.column("tm_row").to_numpy()

        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            vectors, words, names, numbers = part(left)
            index = Index(words)
            for query, code, name, number in zip(*part(right)):
                at, distances = nearest(index, vectors, names, numbers, query.astype(np.float64), code, number, codes, k)
                out.append((np.full(len(at), number), np.full(len(at), name), names[at], distances, numbers[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0), np.zeros(0, np.int64)]
        return pa.table([pa.array(c) for c in columns], names=["tm_query", "query_id", "vec_id", "score", "tm_row"])

    found = whole.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)).applyInArrow(search, schema)
    order = Window.partitionBy("tm_query").orderBy("score", "vec_id", "tm_row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
