"""Phrase collocations (operator 11).

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Arrow passes explode the
1- to max_n-grams of each language into rows; equal grams of a stretch of texts come added up. Nearly all distinct grams
are rare, so words and pairs are first hash-aggregated by a 64-bit hash of language and words. The hashes seen min_count
times go into a Bloom filter (of BLOOM_BITS at most, a bounded broadcast), and a second pass gives the phrases themselves,
as rows (lang, words, phrase, n): words and pairs that the filter holds, and longer grams all of whose pairs it holds, as no
other can be frequent. These are hash-aggregated per language and kept, if seen min_count times, in a stored table. Hashes
that fall together and false hits of the filter only let some rare phrases through to the second count, which is by the
phrase, so counts are exact.

Each candidate's cuts are joined with the counts of their first and second parts, scored in Decimal (products may pass 64
bits), reduced to the lowest-scoring cut, anti-joined with the one-word extensions that hold most of their occurrences, and
ranked by a window.

Extensions by one word are enough: of a longer phrase with so many occurrences, the part one word shorter has as many.

Defined results: null texts count as empty and give no words; a null lang is ``und``; equal rows are counted each; ties
go to the smallest cut and then to the smaller phrase by UTF-8 bytes; a very long text is read in stretches cut between
words, over which phrases go on; a lang without phrases gives no rows, an empty table none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

MAX_N, MIN_COUNT, SHARE, TOP = 3, 10, 50, 2000
NO_LANG = "und"
#: Words that a task holds before it adds up their grams, and bytes of a text that are cut into words at once.
HELD, STRETCH = 1_000_000, 1 << 20
#: Words of the longest grams that are counted by hash.
PAIR = 2
#: Rows of a batch that goes to Spark.
ROWS = 50_000
#: Bits of the filter: the least and most, and for each entry.
BLOOM_LEAST, BLOOM_BITS, BLOOM_EACH, PROBES = 1 << 16, 1 << 28, 16, 3

#: A piece ends at these bytes; the mark that stands for them is no byte of UTF-8.
ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
TABLE = bytes(MARK[0] if b in ENDS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACED = b" " + MARK + b" "

GRAMS = "lang string, words int, phrase string, n long"
SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


class Numbers(dict):
    """Numbers of words in the order first seen; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_numbers(text: bytes, numbers: Numbers) -> Iterator[np.ndarray]:
    """The numbers of text's words and marks, in stretches."""
    plain = text.translate(TABLE)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + STRETCH) if len(plain) - start > STRETCH else -1
        end = len(plain) if end < 0 else end
        words = plain[start:end].replace(MARK, SPACED).split()
        yield np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        start = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)]


def holds(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in places(hashes, len(filter_) * 64):
        found &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def starts(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether a gram of that size begins at a place; a mark is in none."""
    places_ = max(0, len(ids) - size + 1)
    return np.logical_and.reduce([ids[k : k + places_] > 0 for k in range(size)])


def gram_hashes(lang: str, ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the grams of that size that begin at the places at."""
    out = np.full(len(at), np.uint64(lang_hash(lang) + size & 2**64 - 1))
    for k in range(size):
        out = mixed(out, hashes[ids[at + k]])
    return out


def hash_table(lang: str, ids: np.ndarray, numbers: Numbers, sizes: range) -> Iterator[pa.RecordBatch]:
    """Rows (hash, n) of all grams in ids."""
    hashes = word_hashes(list(numbers))
    for size in sizes:
        own = np.sort(gram_hashes(lang, ids, hashes, np.flatnonzero(starts(ids, size)), size))
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(own)))
        for k in range(0, len(first), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(own[first[k : k + ROWS]].view(np.int64)), pa.array(counts[k : k + ROWS])], names=["hash", "n"])


def phrase_table(lang: str, ids: np.ndarray, numbers: Numbers, sizes: range, filter_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lang, words, phrase, n) of the grams in ids that may be frequent, and one for the number of words."""
    words = list(numbers)
    names, hashes = pa.array(words[1:], pa.binary()).cast(pa.string()), word_hashes(words)
    yield phrase_rows(lang, 0, pa.array([""]), np.array([np.count_nonzero(ids)]))
    pairs = np.zeros(0, bool)
    for size in sizes:
        good = starts(ids, size)
        if size > PAIR:
            good = np.logical_and.reduce([pairs[k : k + len(good)] for k in range(size - 1)])
        at = np.flatnonzero(good)
        own = gram_hashes(lang, ids, hashes, at, size)
        if size <= PAIR:
            known = holds(filter_, own)
            at, own = at[known], own[known]
            pairs = np.zeros(len(good), bool)
            pairs[at] = True
        if not len(at):
            continue
        _, first, group, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        if any((ids[at + k] != ids[at[first] + k][group]).any() for k in range(size)):  # two grams with one hash
            _, first, counts = np.unique(np.stack([ids[at + k] for k in range(size)]), axis=1, return_index=True, return_counts=True)
        columns = [names.take(pa.array(ids[at[first] + k] - 1)) for k in range(size)]
        phrases = pc.binary_join_element_wise(*columns, " ")
        for k in range(0, len(first), ROWS):
            yield phrase_rows(lang, size, phrases.slice(k, ROWS), counts[k : k + ROWS])


def phrase_rows(lang: str, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), pa.repeat(pa.scalar(size, pa.int32()), len(counts)), phrases, pa.array(counts, pa.int64())], schema=SCHEMA)


def lang_hash(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode())


def gram_rows(docs: DataFrame, table: Callable[[str, np.ndarray, Numbers], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that table makes of each lang's word numbers, HELD words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts, held = Numbers({MARK: 0}), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in texts.items():
                yield from table(lang, np.concatenate(parts), numbers)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                parts = texts.setdefault(lang.as_py(), [])
                for part in word_numbers(text.as_buffer().to_pybytes() if text.is_valid else b"", numbers):
                    parts.append(part)
                    held += len(part)
                parts.append(np.zeros(1, np.int32))
                if held >= HELD:
                    yield from flush()
                    numbers, texts, held = Numbers({MARK: 0}), {}, 0
        yield from flush()

    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").mapInArrow(run, schema)


def bloom(hashes: DataFrame):
    """A broadcast Bloom filter of the column hash: its set bits are found and OR-ed by Spark."""
    bits, wanted = BLOOM_LEAST, hashes.count() * BLOOM_EACH
    while bits < min(wanted, BLOOM_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at = np.unique(np.concatenate(places(batch.column("hash").to_numpy().view(np.uint64), bits)))
            cell, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(value.view(np.int64))], names=["cell", "value"])

    found = hashes.select("hash").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def frequent_grams(docs: DataFrame, max_n: int, min_count: int) -> DataFrame:
    """lang, words, phrase, n of all phrases of up to max_n words that docs hold min_count times; in the row of each lang
    with 0 words, n counts all its words. Stored, as it has many users."""
    sizes = range(1, max_n + 1)
    hashes = gram_rows(docs, lambda *one: hash_table(*one, sizes[:PAIR]), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    known = bloom(stored(hashes, "gram-hashes"))
    rows = gram_rows(docs, lambda *one: phrase_table(*one, sizes, known.value), GRAMS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(rows.where((F.col("n") >= min_count) | (F.col("words") == 0)), "grams")


def joined_words(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def with_part(cuts: DataFrame, parts: DataFrame, side: str) -> DataFrame:
    """cuts with the count of its part tm_<side> in the column <side>. A part such as a very common word may be in a large
    share of all candidates, so such parts are dealt over several tasks."""
    key = lambda c: F.concat_ws("\n", "lang", c)  # noqa: E731  neither has line ends
    left = cuts.withColumn("tm_key", key(f"tm_{side}"))
    right = parts.select(key("phrase").alias("tm_key"), F.col("n").alias(side))
    sizes = left.groupBy("tm_key").agg(F.count("*").alias("tm_rows"))
    return spread_join(left, right, "tm_key", sizes, F.xxhash64("phrase", "tm_cut")).drop("tm_key", f"tm_{side}")


def scored(known: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of each candidate at its lowest-scoring cut, the first of equals."""
    phrase = known.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("tm_words"))
    cuts = phrase.withColumn("tm_cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"tm_l": joined_words(F.col("tm_words"), 1, F.col("tm_cut")), "tm_r": joined_words(F.col("tm_words"), F.col("tm_cut") + 1, F.col("words") - F.col("tm_cut"))}).drop("tm_words")
    parts = known.where("words >= 1").select("lang", "phrase", "n")
    both = with_part(with_part(cuts, parts, "l"), parts, "r")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    both = both.select("*", (F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")).alias("tm_over"), (exact("l") * exact("r")).alias("tm_under"))
    both = both.withColumn("score", F.expr("tm_over div tm_under"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "tm_cut"))
    return both.groupBy("lang", "words", "phrase", "a").agg(best.alias("tm_best")).select("lang", "words", "phrase", "a", "tm_best.*")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of 2 to max_n words of each lang."""
    known = frequent_grams(docs, max_n, min_count)
    candidates = scored(known)
    long = known.where("words >= 3").select("lang", "words", F.split("phrase", " ").alias("tm_words"), F.col("n").alias("tm_longer"))
    rest = F.col("words") - 1
    ends = F.array(joined_words(F.col("tm_words"), 1, rest), joined_words(F.col("tm_words"), 2, rest))
    extended = long.select(F.col("lang").alias("tm_lang"), F.explode(ends).alias("tm_phrase"), "tm_longer").groupBy("tm_lang", "tm_phrase").agg(F.max("tm_longer").alias("tm_longer"))
    inside = (F.col("lang") == F.col("tm_lang")) & (F.col("phrase") == F.col("tm_phrase")) & (100 * F.col("tm_longer") >= share * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates.join(extended, inside, "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = known.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
