"""Personal data by bootstrapped contextual extraction (operator 5).

Patterns of fixed form find e-mail addresses, IP numbers, payment cards and phone numbers: the seeds. The words before a
seed make a lexical pattern; the words before any identifier-like token (with a digit or an at sign) make one too. Spark
keeps the bipartite graph of patterns and instances (the tokens) and scores it in rounds: a pattern's precision is the
mean belief in its instances, discounted for few distinct ones; an instance's belief, as one of its patterns sees it, is
that at least one of its other patterns is right, 1 for seeds. A pattern thus never confirms itself, and one without any
seed can be trusted through identifiers that other patterns have discovered. Precisions only grow, and rounds go on until
none grows by more than ``tolerance``. Patterns at or above ``min_precision`` with ``min_support`` distinct instances then
report their other tokens as ``context`` spans: identifiers whose form no pattern knows.

Scores are aggregates over all documents, pre-aggregated before each shuffle; a pattern or instance that holds a large
part of the graph is spread over several tasks in each join.

Defined results: a null text is empty; spans are code points, end exclusive; a token that overlaps a base span is never
reported again; a token with fewer words before it than a context has is in no pattern; a very long text is scanned as a
whole, in linear time; tokens of one place are settled by their start, and ties between patterns do not matter, as any
trusted one reports; repeated rows get equal results; extra columns play no part, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored, text_id

#: Kinds in the order of their listing and their patterns.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: An identifier-like token: six characters or more with a digit or an at sign inside, signs at its end left out.
TOKEN = re.compile(r"(?<![^\s(\[<\"'=:,;])[A-Za-z0-9@+][A-Za-z0-9@._%+/-]{5,}+")
TOKEN_SIGNS, TELLING = "@._%+/-", re.compile("[0-9@]")
WORD = re.compile(r"[^\W\d_]++|[:=#]")


@dataclass(frozen=True)
class Bootstrap:
    context_words: int = 2
    tolerance: float = 0.01
    min_support: int = 3
    min_precision: float = 0.5  # without its own vote; with it, 0.6 was reached from less
    prior: float = 1.0  # doubtful instances added to each pattern


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from the at signs in linear time."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end(), "email"
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += emails(text)
    if DIGIT.search(text) is None:
        return found
    if text.count(".") > 2:
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(part_ok(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def part_ok(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def listed(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


class Contexts:
    """The words (or signs) of a text, to find the last ones before a place."""

    def __init__(self, text: str, words: int):
        found = list(WORD.finditer(text))
        self.words, self.ends, self.count = [m[0].lower() for m in found], [m.end() for m in found], words

    def before(self, start: int) -> str | None:
        """The last words before start; None where there are fewer."""
        at = bisect_right(self.ends, start)
        return " ".join(self.words[at - self.count : at]) if at >= self.count else None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    for m in TOKEN.finditer(text):
        token = m[0].rstrip(TOKEN_SIGNS)
        if len(token) >= 6 and TELLING.search(token):
            yield m.start(), m.start() + len(token)


def beside(spans: Iterator[tuple[int, int]], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The spans, which come in order, that overlap none of base."""
    taken, at, end = sorted(s[:2] for s in base), 0, 0
    for start, stop in spans:
        while at < len(taken) and taken[at][0] < stop:
            end, at = max(end, taken[at][1]), at + 1
        if end <= start:
            yield start, stop


def occurrences(text: str, base: list[tuple[int, int, str]], words: int) -> Iterator[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, whether a seed) of seeds and of identifier-like tokens beside them."""
    if "@" not in text and DIGIT.search(text) is None:
        return
    places = [(s[0], s[1], True) for s in base] + [(start, end, False) for start, end in beside(tokens(text), base)]
    known = Contexts(text, words) if places else None
    for start, end, seed in places:
        if pattern := known.before(start):
            yield pattern, text[start:end].lower(), start, end, seed


def scanned(docs: DataFrame, config: Bootstrap) -> DataFrame:
    """doc_id, tm_text, the four counts, base (spans as text) and tm_seen: the occurrences in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_type = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_())]))
        names = ("pattern", "instance", "start", "end", "seed")
        for batch in batches:
            counts, bases, seen = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[2] == k for s in base) for k in KINDS[:4]])
                bases.append(listed(base))
                seen.append([dict(zip(names, o)) for o in occurrences(text, base, config.context_words)])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tm_text"), *columns, pa.array(bases, pa.string()), pa.array(seen, seen_type)], names=["doc_id", "tm_text", "n_email", "n_ip", "n_card", "n_phone", "base", "tm_seen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tm_text long, n_email long, n_ip long, n_card long, n_phone long, base string, tm_seen array<struct<pattern: string, instance: string, start: int, end: int, seed: boolean>>"
    return docs.select("doc_id", text_id(F.col("text")).alias("tm_text"), "text").mapInArrow(run, schema)


def trusted_patterns(seen: DataFrame, config: Bootstrap) -> DataFrame:
    """seen: pattern, instance, seed. Gives pattern, precision, support and tm_rows (rows of seen) of the trusted ones."""
    graph = stored(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pattern-graph")
    patterns = graph.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n").alias("tm_rows"))
    patterns = stored(patterns, "patterns")
    of_pattern = patterns.select("pattern", F.col("support").alias("tm_rows"))
    of_instance = stored(graph.groupBy("instance").agg(F.count("*").alias("tm_rows")), "instances")
    mean = lambda belief: (F.sum(belief) / (F.count("*") + config.prior)).alias("precision")
    scores = stored(graph.groupBy("pattern").agg(mean(F.col("seed").cast("double"))), "pattern-scores")
    while True:
        sides = spread_join(graph.select("pattern", "instance", "seed"), scores, "pattern", of_pattern, F.xxhash64("instance"))
        sides = stored(sides.withColumn("doubt", F.log(1 - F.least("precision", F.lit(0.999999)))), "pattern-sides")
        doubts = sides.groupBy("instance").agg(F.sum("doubt").alias("all_doubt"))
        both = spread_join(sides, doubts, "instance", of_instance, F.xxhash64("pattern"))
        others = 1 - F.exp(F.col("all_doubt") - F.col("doubt"))
        both = both.groupBy("pattern").agg(mean(F.when(F.col("seed"), F.lit(1.0)).otherwise(others)), F.max("precision").alias("before"))
        scores = stored(both, "pattern-scores")
        if not scores.where(F.col("precision") - F.col("before") > config.tolerance).limit(1).count():
            break
        scores = scores.drop("before")
    trusted = scores.where(F.col("precision") >= config.min_precision).select("pattern", "precision")
    return trusted.join(patterns.where(F.col("support") >= config.min_support), "pattern")


def personal_data(docs: DataFrame, config: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end) for each row of docs."""
    rows = stored(scanned(docs.select("doc_id", "text"), config), "scanned")
    seen = rows.select("doc_id", "tm_text", F.inline("tm_seen"))
    trusted = stored(trusted_patterns(seen.select("pattern", "instance", "seed"), config), "trusted")
    found = spread_join(seen.where("not seed"), trusted.select("pattern"), "pattern", trusted.select("pattern", "tm_rows"), F.xxhash64("doc_id", "start"))
    extra = found.groupBy(F.col("doc_id").alias("tm_doc"), F.col("tm_text").alias("tm_id")).agg(F.collect_set(F.struct("start", "end")).alias("tm_extra"))
    both = rows.join(extra, (F.col("tm_text") == F.col("tm_id")) & F.col("doc_id").eqNullSafe(F.col("tm_doc")), "left")
    own = F.transform(F.array_remove(F.split("base", ","), ""), lambda s, i: F.struct(F.split(s, ":")[1].cast("int").alias("at"), i.alias("kind"), s.alias("text")))
    more = F.transform("tm_extra", lambda x: F.struct(x["start"].alias("at"), F.lit(1 << 30).alias("kind"), F.concat(F.lit("context:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")).alias("text")))
    merged = F.array_join(F.transform(F.sort_array(F.concat(own, more)), lambda x: x["text"]), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.when(F.col("tm_extra").isNull(), F.col("base")).otherwise(merged).alias("spans"))
