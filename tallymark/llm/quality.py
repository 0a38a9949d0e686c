"""Quality rules with cross-document line frequency (operator 1).

Normalised lines are hashed together with their host. A line is boilerplate where more than ``max_docs`` distinct
documents of one host hold it. Documents are told apart by their text, so exact copies count once, and so does a group
of near copies, in which each line would be frequent although nothing but the copying repeats. Candidates are the lines
that are frequent by documents alone. A document is taken for a near copy where its other lines, its own part, have
at most ``near_own`` of the words of its distinct lines: two such documents are alike by 0.8 of their words. It counts
for the group of its least candidate line, any other document for itself. However many lines a template has, its pages
thus count one by one as long as they are not near copies, which are left to the near-duplicate operators.

Boilerplate lines are removed; a document is depleted, and rejected, where fewer than ``min_left_words`` words or
``min_left_share`` of its words remain. Everything is DataFrame expressions. Counting aggregates before each shuffle; the
joins back to the lines, whose keys are the most frequent lines by nature, spread each of these over many tasks.

Lines and texts are told apart by all 128 bits of their MD5.

Defined results: a null text has no words and fails the base rules; blank lines are never counted or removed; a null
host is a host of its own; a very long text is one row, whose lines are rows of their own; there are no ties, as counts
alone decide; repeated rows get equal results; an empty table gives an empty result. Input columns other than the named
ones are ignored by the verdicts and passed through by ``clean_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, let, spread_join, stored, words

WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_docs: int = 20
    near_own: float = 1 / 9  # then shared / (shared + 2 own), the likeness of two such documents, is 0.8
    min_left_words: int = 20
    min_left_share: float = 0.3


def repeated_words(tokens: Column) -> Column:
    """Words that lie in WINDOW-word windows found twice or more in tokens; WINDOW is a power of two."""

    def doubled(h: Column, step: int) -> Column:
        """Hashes of windows twice as long as those in h, which span step words."""
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(1 + step), F.size(h) - step), lambda a, b: F.xxhash64(a, b))

    def covered(s: Column) -> Column:
        """s: (hash, position) of all windows in order."""
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), length)

    def length(p: Column) -> Column:
        steps = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, covered))

    def grown(h: Column, step: int) -> Column:
        return counted(h) if step == WINDOW else let(doubled(h, step), lambda x: grown(x, 2 * step))

    found = grown(F.transform(tokens, lambda x: F.xxhash64(x)), 1)
    return F.when(F.size(tokens) > WINDOW, found).otherwise(F.lit(0)).cast("long")


def base_counts(docs: DataFrame, rules: QualityRules = QualityRules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
    )
    counted = docs.select(
        *keep,
        let(words(text), of_words).alias("tm_w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*keep, "tm_w.n_words", "tm_w.word_chars", "n_symbols", "n_dup_lines", "tm_w.n_repeat_words")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


#: Signs of a key in base64.
KEY_TEXT = 24


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_id(text: Column) -> Column:
    return digest(F.coalesce(text, F.lit("")))


def line_key(line: Column, host: Column) -> Column:
    return digest(F.concat(F.coalesce(host, F.lit("\x00")), F.lit("\x1f"), F.lower(F.btrim(line, F.lit(BLANKS)))))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """A row for each non-blank line: doc_id, tm_text, tm_page (the text on its host), tm_total (words of its distinct
    lines), tm_line, tm_at (the line's number) and tm_words."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("x"), i.alias("i")))
    lines = F.filter(numbered, lambda x: F.length(x["x"]) > 0)
    size = lambda x: F.size(F.split(x, BLANK_RUN))
    keyed = F.transform(lines, lambda x: F.struct(line_key(x["x"], F.col(host)).alias("k"), size(x["x"]).alias("w"), x["i"].alias("i")))
    # keys with their words as text, as equal texts are found by hash; of equal keys the words are as many
    weighted = lambda keys: F.array_distinct(F.transform(keys, lambda x: F.concat(F.base64(x["k"]), x["w"].cast("string"))))
    total = lambda keys: F.aggregate(weighted(keys), F.lit(0), lambda a, x: a + F.substr(x, F.lit(KEY_TEXT + 1)).cast("int"))
    page = lambda text: digest(F.concat(F.coalesce(F.col(host), F.lit("\x00")), F.lit("\x1f"), F.hex(text)))
    row = lambda text, page, n: lambda x: F.struct(text.alias("tm_text"), page.alias("tm_page"), n.alias("tm_total"), x["k"].alias("tm_line"), x["i"].alias("tm_at"), x["w"].alias("tm_words"))
    # each value is made once a document, though all its lines carry it
    rows = let(keyed, lambda k: let(total(k), lambda n: let(text_id(F.col("text")), lambda t: let(page(t), lambda p: F.transform(k, row(t, p, n))))))
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.inline(rows))


def frequent_lines(lines: DataFrame, rules: QualityRules) -> DataFrame:
    """tm_line of each line that is boilerplate on its host, with tm_rows, the number of pages that hold it."""
    held = stored(lines.groupBy("tm_line", "tm_page").agg(F.max("tm_words").alias("tm_words"), F.max("tm_total").alias("tm_total")), "held-lines")
    often = stored(held.groupBy("tm_line").agg(F.count("*").alias("tm_rows")).where(F.col("tm_rows") > rules.max_docs), "often")
    hits = stored(spread_join(held, often.select("tm_line"), "tm_line", often, F.xxhash64("tm_page")), "line-hits")
    pages = hits.groupBy("tm_page").agg(F.min("tm_line").alias("tm_least"), (F.max("tm_total") - F.sum("tm_words")).alias("tm_own"), F.max("tm_total").alias("tm_total"))
    near = F.col("tm_own") <= rules.near_own * F.col("tm_total")
    groups = pages.select("tm_page", F.struct(near.alias("near"), F.when(near, F.col("tm_least")).otherwise(F.col("tm_page")).alias("id")).alias("tm_group"))
    counted = hits.select("tm_line", "tm_page").join(groups, "tm_page").select("tm_line", "tm_group").distinct()
    frequent = counted.groupBy("tm_line").agg(F.count("*").alias("tm_docs")).where(F.col("tm_docs") > rules.max_docs)
    return stored(frequent.join(often, "tm_line").select("tm_line", "tm_rows"), "frequent-lines")


def removed_lines(docs: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """A row for each document that loses lines: tm_doc, tm_id and tm_gone, the (number, words) of those lines."""
    lines = stored(host_lines(docs, host), "lines")
    frequent = frequent_lines(lines, rules)
    hit = spread_join(lines, frequent.select("tm_line"), "tm_line", frequent, F.xxhash64("tm_page", "tm_at"))
    gone = F.collect_set(F.struct(F.col("tm_at").alias("at"), F.col("tm_words").alias("w")))
    return hit.groupBy(F.col("doc_id").alias("tm_doc"), F.col("tm_text").alias("tm_id")).agg(gone.alias("tm_gone"))


def stays(gone: Column) -> Column:
    """Whether a line stays, by its number up to the last one that goes, from the sorted numbers of those that go."""
    before = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    return F.flatten(F.transform(gone, lambda at, i: F.concat(F.array_repeat(F.lit(True), at - before(i) - 1), F.array(F.lit(False)))))


def judged(docs: DataFrame, host: str, rules: QualityRules, keep: tuple[str, ...]) -> DataFrame:
    """Base counts, tm_gone and the verdict of each row, with the columns in keep."""
    counts = base_counts(docs.withColumn("tm_text", text_id(F.col("text"))), rules, (*keep, "tm_text"))
    gone = removed_lines(docs, host, rules)
    both = counts.join(gone, (F.col("tm_text") == F.col("tm_id")) & F.col("doc_id").eqNullSafe(F.col("tm_doc")), "left")
    lost = F.coalesce(F.aggregate("tm_gone", F.lit(0), lambda a, x: a + x["w"]), F.lit(0))
    both = both.withColumns({
        "n_removed_lines": F.coalesce(F.array_size("tm_gone"), F.lit(0)).cast("long"),
        "left_words": F.col("n_words") - lost,
    })
    depleted = (F.col("n_removed_lines") > 0) & ((F.col("left_words") < rules.min_left_words) | (F.col("left_words") < rules.min_left_share * F.col("n_words")))
    return both.withColumns({"tm_depleted": depleted, "kept": ~F.col("base_failed") & ~depleted})


def quality_verdicts(docs: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_removed_lines and left_words for each row of docs."""
    return judged(docs.select("doc_id", "text", host), host, rules, ("doc_id",)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "left_words"
    )


def clean_documents(docs: DataFrame, host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; n_chars, where there is one, follows the text."""
    named = ("doc_id", "text", host)
    rows = docs.select(*named, F.struct(F.lit(0).alias("tm_none"), *(c for c in docs.columns if c not in named)).alias("tm_row"))
    # one condition on both sides of the join, as a part of it alone would be moved below and counted there once more
    bad = F.greatest(F.col("base_failed").cast("int"), F.col("tm_depleted").cast("int"))
    rows = judged(rows, host, rules, (*named, "tm_row")).where(bad == 0)
    kept_of = lambda gone: let(stays(gone), lambda keep: F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get(keep, i), F.lit(True))))
    left = let(F.array_sort("tm_gone.at"), kept_of)
    text = F.when(F.col("tm_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = rows.withColumn("text", text)
    columns = {c: F.col(c) if c in named else F.col(f"tm_row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(k) for k, v in columns.items()))
