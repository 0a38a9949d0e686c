"""SimHash near-duplicates over a Gray-order hierarchical index (operator 10).

Fingerprints: a text's words, ASCII letters lower-cased, make shingles; XXH64 (seed 42) of each shingle votes on every
bit, and a bit is set if it is set in over half of them.

Links: fingerprints within ``max_bits`` differing bits. The 64 bits are cut into ``blocks`` slices. With more blocks than
max_bits two linked fingerprints agree in a slice, so no link is lost when each slice in turn is rotated to the front and
only fingerprints that agree there are compared; fewer blocks would lose links and are refused.

Index: for each rotation the fingerprints are range-partitioned and sorted by Gray rank, in which neighbours share long
runs of bits. Equal front slices stay in one partition. Over each stretch of some ten thousand fingerprints a tree is
built: a node holds the bits that all its members share as a mask and a pattern, a child only those not in its parent. A
search adds up differences on the way down and drops a whole group when they exceed max_bits or touch the front slice.
A front slice that more than ``bucket_limit`` fingerprints share is dealt again by slices of the bits behind it, by the
same argument. A stretch reports a spanning forest of its links, at most one row for a fingerprint.

Components: alternating large-star and small-star steps over the links, written to the shared folder after each round.
A fingerprint, hub or component that holds a large part of the rows is spread over several tasks in each join.

Defined results: texts without words have fingerprint zero, linked like any other; equal fingerprints are one node, so
copies need no pairs; a null doc_id never names a component unless all its members are null; repeated rows get equal
results; an empty table gives an empty result; a very long text is one row of a task, hashed as a whole; columns other
than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored, text_id

FANOUT = 8
#: Fingerprints a tree is built over, at least, and comparisons a search holds in memory at once.
STRETCH, FRONT = 1 << 15, 1 << 19
#: Front slices this long are not dealt again: what is left has 65,536 values at most.
LONGEST = 48


@dataclass(frozen=True)
class SimHash:
    shingle: int = 3
    blocks: int = 3
    max_bits: int = 2
    bucket_limit: int = 20_000

    def __post_init__(self) -> None:
        if self.blocks <= self.max_bits:
            raise ValueError("links are only all found with more blocks than max_bits")


def voted(h: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes h."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):
        votes += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big", signed=True)


def code_of(text: str, shingle: int) -> int:
    """The fingerprint of text as a signed number."""
    w = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    grams = [b" ".join(w)] if n == 1 else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    return voted(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n))


def fingerprints(docs: DataFrame, config: SimHash) -> DataFrame:
    """doc_id, tm_text (digest of the text) and tm_node (the fingerprint) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array((code_of(t.as_py() or "", config.shingle) for t in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tm_text"), codes], names=["doc_id", "tm_text", "tm_node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_id(F.col("text")).alias("tm_text"), "text").mapInArrow(run, f"doc_id {kind}, tm_text long, tm_node long")


# --- rotations


def gray_rank(code: Column) -> Column:
    """The Gray rank (prefix XOR) as a signed number in the same order. Its first k bits follow from code's first k."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (tm_way, tm_exact, tm_code, tm_node) once for each slice of the bits behind the first tm_exact, these bits
    rotated so that the slice comes first; tm_exact then ends with it and tm_way numbers the choices so far."""
    parts = rows.select("*", F.explode(F.array(*map(F.lit, range(blocks)))).alias("tm_j"))
    begin, end = (F.floor((64 - F.col("tm_exact")) * (F.col("tm_j") + k) / blocks).cast("int") for k in (0, 1))
    parts = parts.select("tm_way", "tm_exact", "tm_code", "tm_node", "tm_j", begin.alias("tm_begin"), (end - begin).alias("tm_width"))
    parts = parts.withColumn("tm_mask", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.col("tm_exact")))
    low = F.col("tm_code").bitwiseAND(F.col("tm_mask"))
    turned = F.call_function("shiftleft", low, F.col("tm_begin")).bitwiseOR(F.call_function("shiftrightunsigned", low, 64 - F.col("tm_exact") - F.col("tm_begin"))).bitwiseAND(F.col("tm_mask"))
    code = F.col("tm_code").bitwiseAND(F.bitwise_not("tm_mask")).bitwiseOR(turned)
    return parts.select((F.col("tm_way") * (blocks + 1) + F.col("tm_j") + 1).alias("tm_way"), (F.col("tm_exact") + F.col("tm_width")).alias("tm_exact"), code.alias("tm_code"), "tm_node")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with tm_rank (Gray rank) and tm_front (that of the first tm_exact bits)."""
    out = rows.withColumn("tm_rank", gray_rank(F.col("tm_code")))
    return out.withColumn("tm_front", F.call_function("shiftright", F.col("tm_rank"), 64 - F.col("tm_exact")))


def rotations(codes: DataFrame, config: SimHash) -> DataFrame:
    """tm_way, tm_exact, tm_code, tm_node, tm_rank, tm_front: fingerprints (tm_node) in all rotations; front slices that
    too many share are dealt again."""
    front = ["tm_way", "tm_front"]
    rows = ranked(dealt(codes.select(F.lit(0).cast("long").alias("tm_way"), F.lit(0).alias("tm_exact"), F.col("tm_node").alias("tm_code"), "tm_node"), config.blocks))
    done = None
    while True:
        crowded = rows.where(F.col("tm_exact") <= LONGEST).groupBy(*front).count().where(F.col("count") > config.bucket_limit)
        crowded = stored(crowded.select(*front), "crowded")
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(crowded, front, "left_anti").select(rows.columns)
        done = kept if done is None else done.unionByName(kept)
        again = rows.join(crowded, front, "left_semi").select("tm_way", "tm_exact", "tm_code", "tm_node")
        rows = stored(ranked(dealt(again, config.blocks)), "dealt")


# --- the index


class GrayIndex:
    """A tree over codes (unsigned, in Gray order). Levels from the root down: each node's pattern and its mask without
    the bits of its parent's. Node k of a level has the nodes FANOUT k and following below it."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, [(codes, np.full_like(codes, ~np.uint64(0)))]
        self.visited = self.pruned = 0
        while len(self.levels[0][0]) > FANOUT:
            pattern, mask = self.levels[0]
            starts = np.arange(0, len(pattern), FANOUT)
            parent = np.arange(len(pattern)) // FANOUT
            first = pattern[starts]
            differ = np.bitwise_or.reduceat(pattern ^ first[parent], starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~differ
            self.levels[0] = pattern, mask & ~shared[parent]
            self.levels.insert(0, (first & shared, shared))

    def links(self, queries: np.ndarray, most: int, front: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (a, b), b after a, of codes within most differing bits, none of them in front; a among queries."""
        top, bottom = len(self.levels[0][0]), len(self.levels) - 1
        open_ = [(0, np.repeat(queries, top), np.tile(np.arange(top), len(queries)), np.zeros(top * len(queries), np.uint8))]
        while open_:
            depth, q, node, sofar = open_.pop()
            pattern, mask = self.levels[depth]
            differ = (self.codes[q] ^ pattern[node]) & mask[node]
            sofar = sofar + np.bitwise_count(differ)
            later = (node + 1) * FANOUT ** (bottom - depth) > q + 1  # the group ends behind the query
            near = (sofar <= most) & (differ & front == 0) & later
            self.visited, self.pruned = self.visited + len(q), self.pruned + len(q) - int(near.sum())
            q, node, sofar = q[near], node[near], sofar[near]
            if depth == bottom:
                yield q, node
                continue
            below = len(self.levels[depth + 1][0])
            for at in range(0, len(q), FRONT // FANOUT):
                part = slice(at, at + FRONT // FANOUT)
                child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = child < below
                open_.append((depth + 1, np.repeat(q[part], FANOUT)[real], child[real], np.repeat(sofar[part], FANOUT)[real]))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the least member of its set so far) after the sets of a and b are united pairwise."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def linked_sets(index: GrayIndex, most: int, exact: int) -> np.ndarray:
    """For each code the position of the first of its linked set."""
    labels, front = np.arange(len(index.codes)), np.uint64(((1 << exact) - 1) << (64 - exact))
    step = FRONT // FANOUT
    for at in range(0, len(labels), step):
        for a, b in index.links(np.arange(at, min(at + step, len(labels))), most, front):
            labels = joined(labels, a, b)
    return labels


def forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """a, b: links that span the linked sets of rows sorted by tm_way and Gray rank. A tree covers a stretch of one way
    that ends with a front slice, so it holds STRETCH rows and those of one slice at most."""

    def found(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        nodes = rows["tm_node"]
        labels = linked_sets(GrayIndex(rows["tm_code"].view(np.uint64)), most, int(rows["tm_exact"][0]))
        child = np.flatnonzero(labels != np.arange(len(labels)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[labels[child]])], names=["a", "b"])

    columns, held = ("tm_way", "tm_exact", "tm_front", "tm_node", "tm_code"), None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in columns}
        held = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in columns}
        while len(held["tm_way"]):
            own = int(np.searchsorted(held["tm_way"], held["tm_way"][0], side="right"))
            if own == len(held["tm_way"]):  # the way, and its last front slice, may go on
                own = int(np.searchsorted(held["tm_front"], held["tm_front"][-1])) if own >= STRETCH else 0
            if not own:
                break
            yield from found({c: v[:own] for c, v in held.items()})
            held = {c: v[own:] for c, v in held.items()}
    if held is not None and len(held["tm_way"]):
        yield from found(held)


def links(codes: DataFrame, config: SimHash) -> DataFrame:
    """a, b: distinct fingerprints (tm_node) whose links connect all that max_bits connects."""
    rows = rotations(codes, config).repartitionByRange("tm_way", "tm_front").sortWithinPartitions("tm_way", "tm_rank")
    return rows.select("tm_way", "tm_exact", "tm_front", "tm_node", "tm_code").mapInArrow(partial(forest, most=config.max_bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component, for each node of edges (a, b) that is not the root itself."""
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    def joined_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        """A hub's rows may be most of all."""
        return spread_join(rows, least.select("u", "m"), "u", least.select("u", "tm_rows"), F.xxhash64("v"))

    before = mark(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("tm_rows")), "least")
        large = joined_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("tm_rows")), "least")
        small = joined_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(state)
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- results


def with_components(marked: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """marked (tm_node, ...) with component_id. nodes: tm_node, tm_least (least doc_id) and tm_rows (rows of marked) of
    each node; roots: node, root of those that are not roots themselves."""
    named = nodes.join(roots, F.col("tm_node") == F.col("node"), "left").select("tm_node", "tm_least", "tm_rows", F.coalesce("root", "tm_node").alias("tm_root"))
    named = stored(named, "roots")
    least = stored(named.groupBy("tm_root").agg(F.min("tm_least").alias("component_id"), F.count("*").alias("tm_rows")), "least")
    members = spread_join(named.drop("tm_least"), least.drop("tm_rows"), "tm_root", least.drop("component_id"), F.xxhash64("tm_node"))
    members = stored(members.select("tm_node", "component_id", "tm_rows"), "members")
    return spread_join(marked, members.drop("tm_rows"), "tm_node", members.drop("component_id"), F.xxhash64("doc_id", "tm_text"))


def near_duplicates(docs: DataFrame, config: SimHash = SimHash()) -> DataFrame:
    """doc_id, tm_text, fingerprint (hex) and component_id (least doc_id of the component) for each row of docs."""
    marked = stored(fingerprints(docs.select("doc_id", "text"), config), "fingerprints")
    nodes = stored(marked.groupBy("tm_node").agg(F.min("doc_id").alias("tm_least"), F.count("*").alias("tm_rows")), "codes")
    roots = components(links(nodes.select("tm_node"), config))
    return with_components(marked, nodes, roots).select("doc_id", "tm_text", F.lower(F.lpad(F.hex("tm_node"), 16, "0")).alias("fingerprint"), "component_id")
