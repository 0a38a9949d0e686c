"""Near copies of the pipeline: candidates of the SimHash operator, confirmed by the exact similarity of shingle sets.

A text's words, ASCII letters lower-cased, make shingles of five words; a text's set is their distinct 64-bit hashes. Two
sets are linked where their intersection is at least ``percent`` of their union. Equal sets are one node.

Candidates come from two sides. The SimHash operator (fingerprints of the same shingles, linked through its Gray-order
index) gives the close ones, which are most of the copies. At a similarity of 0.8, though, two fingerprints differ in 15 %
of their bits, far beyond what any index of them can search without comparing nearly all pairs. So the rest comes from
``bands`` keys a set, each of the least values of ``rows`` random orders: sets of similarity s share one key with
probability s ** rows, so a pair at exactly 0.8 is without a common key in 0.59 ** 40, or 7 in 10 ** 10, cases, a closer
one more rarely. Unlike sets hardly ever share a key, so buckets are never sampled or cut.

Links: each pair that shares a bucket is held against the exact similarity, unless other links connect it already. First
each set proposes one link, to the set with most companions that it shares a bucket with, which for a copy is about the
text that was copied: a large group of copies of one text thus costs a row a copy, and not one for each two copies. What
is left are buckets whose members are not connected. Shingles of their own keep many sets out of these: of a set with n
hashes of which only x occur in any other open set, x at most can be shared, so two sets have at most m = min(x, x') in
common and a similarity of m / (n + n' - m) at most; a set whose bound is below ``percent`` with all others of its bucket
is left out, which loses no link.

The rest are mostly large groups of texts that are somewhat alike, but not enough, of which each two would be a pair. No
pair is made of them: the sets that open buckets connect are dealt into blocks of ``small`` sets (fewer if they are long),
and for each two blocks of a group one task has the sizes of all intersections from a product of matrices of zeros and
ones, set by hash, which is exact. It returns links that connect what is alike, at most one fewer than it has sets. So rows
and stored data grow with the sets times the blocks of their group, and only multiplications with the pairs.

Defined results: texts without words have the empty set, which is linked to itself only; a text shorter than a shingle is
one shingle; otherwise as in simhash.
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

from . import simhash
from .common import spread_join, stored, text_id


@dataclass(frozen=True)
class Shingles:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 4
    small: int = 512  # sets of a block
    index: simhash.SimHash = simhash.SimHash(shingle=5)


FIVE_WORDS = Shingles()
#: Hashes of a set that meet all orders at once; those of a block on average at most, and of one product of matrices.
FRONT, BLOCK_HASHES, PRODUCT = 2048, 500_000, 4096


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def constants(n: int, stream: int) -> np.ndarray:
    """n odd numbers, the same in every process."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 32)) | np.uint64(1)


def set_of(text: str, shingle: int) -> np.ndarray:
    """Distinct shingle hashes of text in order."""
    w = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = min(len(w), shingle)
    sums = np.zeros(len(w) - n + 1 if n else 0, np.uint64)
    for at, c in enumerate(constants(n, 1)):
        sums += h[at : at + len(sums)] * c
    return np.unique(mixed(sums + np.uint64(n)))


def keys_of(values: np.ndarray, config: Shingles) -> np.ndarray:
    """A key for each band; none for the empty set."""
    if not len(values):
        return np.empty(0, np.uint64)
    count = config.bands * config.rows
    factors, least = constants(count, 2)[:, None], None
    for at in range(0, len(values), FRONT):
        part = (values[None, at : at + FRONT] * factors).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    parts = (mixed(least).reshape(config.bands, config.rows) * constants(config.rows, 3)).sum(axis=1, dtype=np.uint64)
    return mixed(parts + np.arange(config.bands, dtype=np.uint64))


def listed(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def sets(docs: DataFrame, config: Shingles, values: bool) -> DataFrame:
    """doc_id, tm_text, tm_node, tm_code (SimHash) and tm_list, which is the set with values and else its keys, for each
    row of docs."""

    def run(batches: Iterator[pa.RecordBatch], config: Shingles, values: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                own = [set_of(t.as_py() or "", config.shingle) for t in rows.column("text")]
                nodes = pa.array((xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in own), pa.int64())
                codes = pa.array((simhash.voted(s) if len(s) and not values else 0 for s in own), pa.int64())
                lists = listed(own if values else [keys_of(s, config) for s in own])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tm_text"), nodes, codes, lists], names=["doc_id", "tm_text", "tm_node", "tm_code", "tm_list"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tm_text", "text").mapInArrow(partial(run, config=config, values=values), f"doc_id {kind}, tm_text long, tm_node long, tm_code long, tm_list array<long>")


def alike(a: Column, b: Column, config: Shingles) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= config.percent * (F.size(a) + F.size(b) - both)


def index_pairs(nodes: DataFrame, config: Shingles) -> DataFrame:
    """a, b: candidates of the SimHash operator, where each fingerprint stands for its least node."""
    named = nodes.where(F.size("tm_list") > 0).groupBy("tm_code").agg(F.min("tm_node").alias("tm_first"), F.count("*").alias("tm_rows"))
    named = stored(named, "codes")
    links = simhash.links(named.select(F.col("tm_code").alias("tm_node")), config.index)
    one = lambda side: named.select(F.col("tm_code").alias(side), F.col("tm_first").alias(f"tm_{side}"))
    near = links.join(one("a"), "a").join(one("b"), "b").select(F.col("tm_a").alias("a"), F.col("tm_b").alias("b"))
    same = spread_join(nodes.where(F.size("tm_list") > 0).select("tm_code", "tm_node"), named.select("tm_code", "tm_first"), "tm_code", named.select("tm_code", "tm_rows"), F.xxhash64("tm_node"))
    same = same.where("tm_node <> tm_first").select(F.col("tm_first").alias("a"), F.col("tm_node").alias("b"))
    return near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def buckets(nodes: DataFrame, config: Shingles) -> DataFrame:
    """tm_key, tm_node, tm_n (size of the bucket) and tm_with (companions in all buckets) for buckets of two or more."""
    rows = nodes.select("tm_node", F.explode("tm_list").alias("tm_key"))
    shared = stored(rows.groupBy("tm_key").agg(F.count("*").alias("tm_rows")).where("tm_rows > 1"), "shared-keys")
    rows = spread_join(rows, shared.select("tm_key", F.col("tm_rows").alias("tm_n")), "tm_key", shared, F.xxhash64("tm_node"))
    rows = stored(rows.select("tm_key", "tm_node", "tm_n"), "bucket-rows")
    return rows.join(rows.groupBy("tm_node").agg(F.sum("tm_n").alias("tm_with")), "tm_node")


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.drop("root").join(links.withColumnRenamed("node", "tm_node"), "tm_node", "left").withColumn("root", F.coalesce("root", "tm_node"))


def still_open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are not all connected yet, with tm_rows, their number in the bucket."""
    state = rows.drop("tm_rows").groupBy("tm_key").agg(F.min("root").alias("m"), F.max("root").alias("n"), F.count("*").alias("tm_rows"))
    state = stored(state.where("m <> n").select("tm_key", "tm_rows"), "open-keys")
    return spread_join(rows.drop("tm_rows"), state, "tm_key", state, F.xxhash64("tm_node"))


def can_link(x: Column, n: Column, x2: Column, n2: Column, config: Shingles) -> Column:
    """Whether sets of n and n2 hashes, of which x and x2 can be shared, may be alike."""
    m = F.least(x, x2)
    return 100 * m >= config.percent * (n + n2 - m)


def bounded(rows: DataFrame, own: DataFrame, config: Shingles) -> DataFrame:
    """rows with x and n of can_link, without members that can be linked to none of their bucket. Hashes are counted over
    the sets of rows, as only these are still to be linked."""
    nodes = rows.select("tm_node").distinct()
    hashes = own.join(nodes, "tm_node", "left_semi").select("tm_node", F.explode("tm_list").alias("h"))
    alone = hashes.groupBy("h").agg(F.min("tm_node").alias("tm_node"), F.count("*").alias("c")).where("c = 1").groupBy("tm_node").agg(F.count("*").alias("u"))
    size = own.select("tm_node", F.size("tm_list").cast("long").alias("n")).join(nodes, "tm_node", "left_semi").join(alone, "tm_node", "left")
    size = stored(size.select("tm_node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("x")), "bounds")
    rows = stored(rows.join(size, "tm_node"), "bounded")
    # the smallest set and the one with most to share stand for all others of the bucket
    best = stored(rows.groupBy("tm_key").agg(F.min("n").alias("n2"), F.max("x").alias("x2"), F.count("*").alias("tm_rows")), "bucket-bounds")
    both = spread_join(rows.drop("tm_rows"), best.drop("tm_rows"), "tm_key", best.select("tm_key", "tm_rows"), F.xxhash64("tm_node"))
    return both.where(can_link(F.col("x"), F.col("n"), F.least("x2", "n2"), F.col("n2"), config)).drop("n2", "x2")


def merged(links: DataFrame, edges: DataFrame) -> DataFrame:
    """links (node, root) after the roots that edges (a, b) connect have become one."""
    moved = stored(simhash.components(edges), "moved").withColumnRenamed("root", "to")
    if moved.isEmpty():
        return links
    sizes = links.groupBy("root").agg(F.count("*").alias("tm_rows"))
    to = moved.withColumnRenamed("node", "root")
    old = spread_join(links, to, "root", sizes.join(to.select("root"), "root", "left_semi"), F.xxhash64("node")).select("node", F.col("to").alias("root"))
    same = links.join(F.broadcast(to.select("root")) if moved.count() < 10_000 else to.select("root"), "root", "left_anti").select("node", "root")
    return stored(old.unionByName(same).unionByName(moved.select("node", F.col("to").alias("root"))), "links")


def proposals(rows: DataFrame) -> DataFrame:
    """a, b: for each set b the set a with most companions that shares a bucket with it."""
    best = rows.groupBy("tm_key").agg(F.max(F.struct("tm_with", "tm_node")).alias("p"), F.count("*").alias("tm_rows"))
    best = stored(best.select("tm_key", "p.tm_with", F.col("p.tm_node").alias("a"), "tm_rows"), "best")
    seen = spread_join(rows.select("tm_key", F.col("tm_node").alias("b")), best.drop("tm_rows"), "tm_key", best.select("tm_key", "tm_rows"), F.xxhash64("b"))
    return seen.groupBy("b").agg(F.max_by("a", F.struct("tm_with", "a")).alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def intersections(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each of the sets left has in common with each of the sets right; both are places in lists."""
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lists)), sizes)
    _, number, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[number] > 1  # the others are in no intersection
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(left), len(right)))
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, PRODUCT):
        at = slice(*np.searchsorted(number, (low, low + PRODUCT)))
        part = np.zeros((len(lists), PRODUCT), np.float32)
        part[owner[at], number[at] - low] = 1
        out += part[left] @ part[right].T
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those pairs of a and b that connect what is not connected by the ones before."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            above[x] = x = above.get(above[x], above[x])
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        if (u := root(x)) != (v := root(y)):
            above[max(u, v)] = min(u, v)
            kept.append((x, y))
    return kept


def block_links(block: pa.Table, percent: int) -> pa.Table:
    """a, b: roots that pairs of sets of one or two blocks connect. block: root, tm_block, tm_list."""
    block = block.combine_chunks()
    roots, own, lists = block.column("root").to_numpy(), block.column("tm_block").to_numpy(), block.column("tm_list").chunk(0)
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    both, sizes = intersections(lists, left, right), np.diff(lists.offsets.to_numpy())
    x, y = np.nonzero((100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)) & (roots[left][:, None] != roots[right]))
    found = spanning(roots[left[x]], roots[right[y]])
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def linked_in_blocks(rows: DataFrame, own: DataFrame, config: Shingles) -> DataFrame:
    """a, b: links between the roots of alike sets that open buckets connect. rows: tm_key, tm_node, root, tm_rows."""
    least = stored(rows.groupBy("tm_key").agg(F.min("tm_node").alias("a"), F.count("*").alias("tm_rows")), "least-nodes")
    edges = spread_join(rows.select("tm_key", F.col("tm_node").alias("b")), least.select("tm_key", "a"), "tm_key", least.select("tm_key", "tm_rows"), F.xxhash64("b")).select("a", "b")
    group = simhash.components(edges).select(F.col("node").alias("tm_node"), F.col("root").alias("tm_group"))
    nodes = rows.select("tm_node", "root").distinct().join(group, "tm_node", "left").withColumn("tm_group", F.coalesce("tm_group", "tm_node"))
    sets_ = stored(nodes.join(own, "tm_node"), "open-sets")
    sizes = sets_.groupBy("tm_group").agg(F.count("*").alias("tm_rows"), F.sum(F.size("tm_list")).alias("tm_hashes"))
    sizes = stored(sizes.withColumn("tm_blocks", F.greatest(F.ceil(F.col("tm_rows") / config.small), F.ceil(F.col("tm_hashes") / BLOCK_HASHES))), "groups")
    dealt = spread_join(sets_, sizes.select("tm_group", "tm_blocks"), "tm_group", sizes.select("tm_group", "tm_rows"), F.xxhash64("tm_node"))
    dealt = dealt.withColumn("tm_block", F.pmod(F.xxhash64("tm_node"), "tm_blocks"))
    dealt = dealt.withColumn("tm_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tm_blocks") - 1)))
    dealt = dealt.select("tm_group", F.least("tm_block", "tm_other").alias("tm_i"), F.greatest("tm_block", "tm_other").alias("tm_j"), "root", "tm_block", "tm_list")

    def compare(block: pa.Table) -> pa.Table:
        return block_links(block, config.percent)

    found = dealt.groupBy("tm_group", "tm_i", "tm_j").applyInArrow(compare, "a long, b long")
    return stored(found.distinct(), "block-links")


def linked(docs: DataFrame, nodes: DataFrame, config: Shingles) -> DataFrame:
    """node, root: the least node of each node that is linked to a lesser one, over one row of docs for each node."""
    near = stored(index_pairs(nodes, config), "index-pairs")
    rows = stored(buckets(nodes, config), "buckets")
    wanted = rows.select("tm_node").unionByName(near.select(F.col("a").alias("tm_node"))).unionByName(near.select(F.col("b").alias("tm_node"))).distinct()
    one = nodes.join(wanted, "tm_node", "left_semi").select(F.col("tm_who.id").alias("tm_id"), F.col("tm_who.text").alias("tm_text2"))
    one = docs.join(one, (F.col("tm_text") == F.col("tm_text2")) & F.col("doc_id").eqNullSafe(F.col("tm_id")), "left_semi")
    own = sets(one, config, values=True)
    own = stored(own.dropDuplicates(["tm_node"]).select("tm_node", "tm_list"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike. One set may be in most pairs."""
        pairs = stored(pairs, "pairs")
        for side, name in (("a", "x"), ("b", "y")):
            sizes = pairs.groupBy(side).agg(F.count("*").alias("tm_rows"))
            pairs = spread_join(pairs, own.select(F.col("tm_node").alias(side), F.col("tm_list").alias(name)), side, sizes, F.xxhash64("a", "b"))
        return pairs.where(alike(F.col("x"), F.col("y"), config)).select("a", "b")

    links = stored(simhash.components(confirmed(near.unionByName(proposals(rows)).distinct())), "links")
    rows = stored(still_open(with_roots(rows, links)), "open")
    if not rows.isEmpty():
        rows = stored(still_open(bounded(rows, own, config)), "open")
    if not rows.isEmpty():
        links = merged(links, linked_in_blocks(rows, own, config))
    return links


def near_copies(docs: DataFrame, config: Shingles = FIVE_WORDS) -> DataFrame:
    """doc_id, tm_text, fingerprint (of the set) and component_id (least doc_id of the component) for each row of docs."""
    texts = docs.select("doc_id", text_id(F.col("text")).alias("tm_text"), "text")
    marked = stored(sets(texts, config, values=False), "keys")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  # the same for all rows of a node
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tm_text").alias("text")))
    nodes = marked.groupBy("tm_node").agg(F.min("doc_id").alias("tm_least"), F.count("*").alias("tm_rows"), who.alias("tm_who"), first("tm_code"), first("tm_list"))
    nodes = stored(nodes, "nodes")
    found = simhash.with_components(marked.select("doc_id", "tm_text", "tm_node"), nodes.select("tm_node", "tm_least", "tm_rows"), linked(texts, nodes, config))
    return found.select("doc_id", "tm_text", F.hex("tm_node").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, config: Shingles = FIVE_WORDS) -> DataFrame:
    """One row of docs for each group of near copies: the one with the least doc_id, then the least digest of its text."""
    groups = near_copies(docs, config)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tm_text").alias("text")))
    # components without any doc_id are told apart by their fingerprints
    chosen = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("tm_f")).agg(first.alias("c"))
    chosen = chosen.select(F.col("c.id").alias("tm_id"), F.col("c.text").alias("tm_text2")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("tm_row"), "doc_id", text_id(F.col("text")).alias("tm_text"))
    kept = rows.join(chosen, (F.col("tm_text") == F.col("tm_text2")) & F.col("doc_id").eqNullSafe(F.col("tm_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "tm_text"]).select("tm_row.*")
