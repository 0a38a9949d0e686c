"""Exact line deduplication with keep bitmaps (operator 3).

Each line of MIN_KEY or more code points (stripped, ASCII letters lower-cased) becomes a row (hash, document, position).
The rows are range-partitioned by hash and document and sorted within partitions, largest document first. A pass over
each partition sees every hash as one run: its first document keeps the lines, the others lose theirs if the run has
MIN_DOCS documents. Range bounds may cut the run of a very frequent line, so a hot line spreads over many tasks; the
runs at both ends of a partition, and such as are longer than HELD rows, are reported with their counts, which are added
up by hash. The result is a keep bitmap for each document that loses lines, not a text.

Defined results: doc_id is a whole number; null and empty texts are one empty line; a null doc_id is a document smaller
than all others; rows with equal doc_id are one document, which keeps or loses a key as a whole, so there are no ties;
equal rows get equal results; a very long text is one row, whose lines are rows of their own; extra columns are untouched,
whatever their names; an empty table gives an empty result. Keys are told apart by 64 bits of XXH64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, spread_join, stored, text_id

MIN_KEY, MIN_DOCS = 40, 5
#: Stands for a null doc_id.
NO_DOC = -(2**63)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, min_key: int) -> DataFrame:
    """tm_hash, tm_doc, tm_id (digest of the text), tm_at (position) and tm_lines (number) of each line with a long key."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id has to be a whole number: the largest one keeps a line")
    keys = F.transform(text_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    rows = docs.select("doc_id", text_id(F.col("text")).alias("tm_id"), keys.alias("tm_keys"))
    rows = rows.select("doc_id", "tm_id", F.size("tm_keys").alias("tm_lines"), F.posexplode("tm_keys").alias("tm_at", "tm_key")).where(F.length("tm_key") >= min_key)
    return rows.select(F.xxhash64(ascii_lower(F.col("tm_key"))).alias("tm_hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("tm_doc"), "tm_id", "tm_at", "tm_lines")


COLUMNS = ("tm_hash", "tm_doc", "tm_id", "tm_at", "tm_lines")
RUN_FIELDS = pa.schema([("tm_hash", pa.int64()), ("tm_doc", pa.int64()), ("tm_id", pa.int64()), ("tm_at", pa.int32()), ("tm_lines", pa.int32()), ("tm_edge", pa.bool_()), ("tm_first", pa.int64())])
RUN_SCHEMA = "tm_hash long, tm_doc long, tm_id long, tm_at int, tm_lines int, tm_edge boolean, tm_first long"
#: Rows of one hash that a task holds before it passes them on as an edge.
HELD = 100_000


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def run_pass(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of runs that begin and end within the partition, the rows that lose their line. Of the first and the last run, and
    of runs over HELD rows, all rows with tm_edge true; tm_first is 1 at the first row of each document and 0 else.

    Only the run that may go on in the next batch is held, at most HELD rows of it.
    """
    held: np.ndarray | None = None
    edge_hash, last = None, None  # runs of edge_hash go out as edges; last: the (hash, document) seen last

    def sent(rows: dict[str, np.ndarray], edge: bool) -> Iterator[pa.RecordBatch]:
        if len(rows["tm_at"]):
            n = len(rows["tm_at"])
            own = [pa.array(rows[k], RUN_FIELDS.field(k).type) for k in COLUMNS]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(n, edge)), pa.array(rows["tm_first"].astype(np.int64))], schema=RUN_FIELDS)

    def cut(rows: dict[str, np.ndarray], keep: slice | np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[keep] for k, v in rows.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in COLUMNS}
        rows["tm_first"] = changes(rows["tm_hash"], rows["tm_doc"])
        rows["tm_first"][0] = last != (rows["tm_hash"][0], rows["tm_doc"][0])
        last = (rows["tm_hash"][-1], rows["tm_doc"][-1])
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        if edge_hash is None:
            edge_hash = rows["tm_hash"][0]
        at_edge = rows["tm_hash"] == edge_hash
        yield from sent(cut(rows, at_edge), True)
        rows = cut(rows, ~at_edge)
        open_from = np.searchsorted(rows["tm_hash"], rows["tm_hash"][-1]) if len(rows["tm_at"]) else 0
        held, done = cut(rows, slice(open_from, None)), cut(rows, slice(0, open_from))
        if open_from:
            start = changes(done["tm_hash"])
            run = np.cumsum(start) - 1
            docs = np.bincount(run, weights=done["tm_first"])
            top = done["tm_doc"][start]
            yield from sent(cut(done, (docs[run] >= min_docs) & (done["tm_doc"] != top[run])), False)
        if len(held["tm_at"]) > HELD:
            yield from sent(held, True)
            edge_hash, held = held["tm_hash"][0], None
    if held is not None:
        yield from sent(held, True)


def packed(lines: pd.Series, lost: pd.Series) -> pd.Series:
    """Bitmaps, a bit for each line, 1 for kept, compressed by zlib."""

    def one(n: int, at: np.ndarray) -> bytes:
        bits = np.ones(n, np.uint8)
        bits[at] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return pd.Series([one(n, at) for n, at in zip(lines, lost)], dtype=object)


def unpacked(bitmap: pd.Series) -> pd.Series:
    """Whether each line is kept, from packed bitmaps; padding bits are beyond the last line."""
    bits = lambda b: np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8)).astype(bool)
    return bitmap.map(bits, na_action="ignore")


def keep_bitmaps(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, tm_id (digest of the text), n_lines, n_dropped, keep_bitmap of each document that loses lines."""
    lines = stored(line_rows(docs.select("doc_id", "text"), min_key), "line-rows")  # so that range bounds read no text
    order = [F.asc("tm_hash"), F.desc("tm_doc")]
    ranked = lines.repartitionByRange(*order).sortWithinPartitions(*order, "tm_id", "tm_at")
    found = stored(ranked.mapInArrow(partial(run_pass, min_docs=min_docs), RUN_SCHEMA), "runs")
    edges = found.where("tm_edge")
    totals = edges.groupBy("tm_hash").agg(F.sum("tm_first").alias("tm_docs"), F.max("tm_doc").alias("tm_top"), F.count("*").alias("tm_rows")).where(F.col("tm_docs") >= min_docs)
    cut = spread_join(edges, totals.select("tm_hash", "tm_top"), "tm_hash", totals.select("tm_hash", "tm_rows"), F.xxhash64("tm_doc", "tm_at")).where("tm_doc <> tm_top")
    lost = found.where("not tm_edge").select("tm_doc", "tm_id", "tm_at", "tm_lines").unionByName(cut.select("tm_doc", "tm_id", "tm_at", "tm_lines"))
    lost = lost.groupBy("tm_doc", "tm_id").agg(F.max("tm_lines").alias("n_lines"), F.collect_set("tm_at").alias("tm_lost"))
    pack = F.pandas_udf(packed, "binary")
    return lost.select(F.nullif("tm_doc", F.lit(NO_DOC)).alias("doc_id"), "tm_id", F.col("n_lines").cast("long"), F.size("tm_lost").cast("long").alias("n_dropped"), pack("n_lines", "tm_lost").alias("keep_bitmap"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, then tm_kept (the text without its lost lines), tm_n and tm_dropped."""
    maps = bitmaps.select(F.col("doc_id").alias("tm_doc"), F.col("tm_id").alias("tm_id2"), F.pandas_udf(unpacked, "array<boolean>")("keep_bitmap").alias("tm_keep"), "n_dropped")
    rows = docs.select(*keep, "text" if "text" not in keep else F.lit(0).alias("tm_none"), text_id(F.col("text")).alias("tm_id"))
    both = rows.join(maps, (F.col("tm_id") == F.col("tm_id2")) & F.col("doc_id").eqNullSafe(F.col("tm_doc")), "left")
    left = F.filter(text_lines(F.col("text")), lambda x, i: F.get(F.col("tm_keep"), i))
    kept = F.when(F.col("tm_keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    return both.select(*keep, kept.alias("tm_kept"), F.size(text_lines(F.col("text"))).cast("long").alias("tm_n"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("tm_dropped"))


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of docs."""
    kept = kept_lines(docs, keep_bitmaps(docs, min_key, min_docs), ["doc_id"])
    return kept.select("doc_id", F.col("tm_n").alias("n_lines"), F.col("tm_dropped").alias("n_dropped"), F.sha2("tm_kept", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lost lines taken out of the texts; n_chars, where there is one, follows the text."""
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("tm_none"), *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("tm_row"))
    kept = kept_lines(rows, keep_bitmaps(docs, min_key, min_docs), ["doc_id", "text", "tm_row"])
    text = F.when(F.col("tm_dropped") > 0, F.col("tm_kept")).otherwise(F.col("text"))
    columns = {c: F.col(f"tm_row.`{c}`") for c in docs.columns} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(columns[c].alias(c) for c in docs.columns))
