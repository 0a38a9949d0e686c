"""Mixing sources to target weights by hierarchical budgets (operator 8).

Weights run down a tree, here domain, language and source. From the root on, each node's budget is dealt to its children
by weight; a child that cannot use its share (all tokens below it, times the epochs allowed) is filled up, and what it
leaves goes to its siblings by weight. A node's capacity is that of its whole subtree, so a shortage leaves a family
only when the family as a whole is short. Filling children in the order of capacity over weight gives the shares in one
pass of window sums.

A leaf then takes whole epochs of its documents, each in an order of its own seeded by epoch, and of the last epoch the
prefix that its budget pays for. Orders are cut into ranges of the seeded hash, 2**STEP of them: sums per range tell which
range holds the end of the prefix. A range that holds more than SMALL rows is cut again in the same way, and only what is
left then is ranked row by row, so no task orders a large part of a hot leaf.

Tokens are blank-separated words unless another column expression is given; a tokenizer's counts can be joined to docs
before and named there.

Defined results: missing weights are 1; null names are nodes of their own; documents without tokens come with each epoch
that reaches them, those right behind the end of a prefix included; repeated rows count each by itself, and where the budget ends among equal rows as many as it pays for
are taken; equal places in a seeded order go by the text's digest, and rows equal in that too are alike; a very long text
is one record, which the prefix takes as a whole or ends before; a zero or negative weight takes nothing; columns beside
the levels, doc_id and text play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest60, stored, text_id, words

#: Bits of a seeded hash, those that each cut takes, and the rows of a leaf that one task may rank.
ORDER_BITS, STEP, SMALL = 60, 8, 100_000


@dataclass(frozen=True)
class Mix:
    levels: Sequence[str] = ("domain", "lang", "source")
    weights: dict[str, dict[str, float]] = field(default_factory=dict)  # by level and name
    share: float = 0.6  # of all tokens, taken as the budget
    epochs: int = 2  # times a document is taken at most
    seed: int = 17


def weight(level: str, mix: Mix) -> Column:
    value = F.lit(1.0)
    for name, w in mix.weights.get(level, {}).items():
        value = F.when(F.col(level) == name, F.lit(float(w))).otherwise(value)
    return value


def filled(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes: parent columns, level, tm_weight, tm_cap (long) and tm_budget (of the parent). Gives each node's tm_share.

    In the order of cap / weight, a node whose weighted share of what is left exceeds its cap gets its cap; from the
    first that does not, all get shares by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("tm_cap") / F.col("tm_weight"), F.col(level))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = nodes.where("tm_weight > 0").withColumns({
        "tm_left": F.col("tm_budget") - F.coalesce(F.sum("tm_cap").over(earlier), F.lit(0)),
        "tm_open": F.sum("tm_weight").over(later),
    })
    full = F.col("tm_cap") * F.col("tm_open") <= F.col("tm_left") * F.col("tm_weight")
    # tokens for a unit of weight at the first that is not filled up; further ones, which count it as full, have less
    rate = F.max(F.when(~full, F.col("tm_left") / F.col("tm_open"))).over(Window.partitionBy(*parent))
    return ranked.withColumn("tm_share", F.when(full, F.col("tm_cap").cast("double")).otherwise(F.col("tm_weight") * rate)).drop("tm_left", "tm_open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: the levels and tm_tokens (long). Gives the levels, tm_tokens and budget (long) of each leaf."""
    levels = list(mix.levels)
    caps = leaves.withColumn("tm_cap", F.col("tm_tokens") * mix.epochs)
    total = leaves.agg(F.floor(F.sum("tm_tokens") * mix.share).cast("double").alias("tm_budget"))
    above = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = caps.groupBy(*parent, level).agg(F.sum("tm_cap").alias("tm_cap")).withColumn("tm_weight", weight(level, mix))
        if above is None:
            nodes = nodes.join(F.broadcast(total))  # one row
        else:
            same = [nodes[c].eqNullSafe(above[f"tm_{c}"]) for c in parent]
            nodes = nodes.join(above, same)
        nodes = filled(nodes.select(*parent, level, "tm_cap", "tm_weight", "tm_budget"), parent or [F.lit(0)], level)
        above = nodes.select(*(F.col(c).alias(f"tm_{c}") for c in levels[: depth + 1]), F.col("tm_share").alias("tm_budget"))
    same = [leaves[c].eqNullSafe(above[f"tm_{c}"]) for c in levels]
    return leaves.join(above, same).select(*levels, "tm_tokens", F.floor(F.col("tm_budget") + 1e-6).cast("long").alias("budget"))


def mixed(docs: DataFrame, mix: Mix = Mix(), tokens: Column | None = None) -> DataFrame:
    """docs: doc_id, text and the levels. Gives doc_id, tm_text (digest of the text), the levels, n_tokens, epoch (from 0)
    and budget (of the leaf): a row for each time a document is taken."""
    levels = list(mix.levels)
    size = (F.size(words(F.col("text"))) if tokens is None else tokens).cast("long")
    rows = stored(docs.select("doc_id", text_id(F.col("text")).alias("tm_text"), *levels, size.alias("n_tokens")), "sizes")
    leaf = budgets(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tm_tokens")), mix)
    leaf = leaf.withColumn("tm_leaf", F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in levels)))
    leaf = stored(leaf.where("budget > 0").select("tm_leaf", *(F.col(c).alias(f"tm_{c}") for c in levels), "tm_tokens", "budget"), "leaves")

    epochs = F.explode(F.array(*(F.lit(e) for e in range(mix.epochs))))
    whole = F.floor(F.col("budget") / F.greatest("tm_tokens", F.lit(1)))
    parts = leaf.withColumn("epoch", epochs).where(F.col("epoch") <= whole).withColumn("tm_left", F.col("budget") - F.col("epoch") * F.col("tm_tokens"))
    parts = parts.where("tm_left > 0")
    same = [rows[c].eqNullSafe(parts[f"tm_{c}"]) for c in levels]
    taken = rows.join(parts, same).select(*rows.columns, "tm_leaf", "epoch", "budget", "tm_left", "tm_tokens")
    order = digest60(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tm_text").cast("string")))
    taken = taken.withColumn("tm_order", order)
    columns = ["doc_id", "tm_text", *levels, "n_tokens", "epoch", "budget"]
    parts = [taken.where("tm_left >= tm_tokens").select(*columns)]
    cut, shift, key = taken.where("tm_left < tm_tokens").withColumn("tm_before", F.lit(0).cast("long")), ORDER_BITS, ["tm_leaf", "epoch"]
    while True:
        shift = max(0, shift - STEP)
        cut = cut.withColumn("tm_bucket", F.shiftright("tm_order", shift))
        sums = cut.groupBy(*key, "tm_bucket", "tm_left", "tm_before").agg(F.sum("n_tokens").alias("tm_sum"))
        earlier = F.sum("tm_sum").over(Window.partitionBy(*key).orderBy("tm_bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("tm_start", F.col("tm_before") + F.coalesce(earlier, F.lit(0)))
        reached = sums.where("tm_start <= tm_left").select(*key, "tm_bucket", "tm_start", (F.col("tm_start") + F.col("tm_sum") > F.col("tm_left")).alias("tm_cut"))
        both = cut.drop("tm_before").join(reached, [*key, "tm_bucket"])
        parts.append(both.where("not tm_cut").select(*columns))
        cut = stored(both.where("tm_cut").withColumnRenamed("tm_start", "tm_before").drop("tm_cut", "tm_bucket"), "cut-ranges")
        if shift == 0 or (cut.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= SMALL:
            break
    ranked = Window.partitionBy(*key).orderBy("tm_order", "tm_text")
    upto = F.sum("n_tokens").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts.append(cut.withColumn("tm_upto", F.col("tm_before") + upto).where("tm_upto <= tm_left").select(*columns))
    return reduce(DataFrame.unionByName, parts)


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of docs that are taken, each once; mix.epochs has to be 1. The levels are columns of docs."""
    if mix.epochs != 1:
        raise ValueError("documents repeat with more than one epoch; use mixed()")
    key = [F.col("doc_id").alias("tm_id"), F.col("tm_text").alias("tm_text2")]
    chosen = stored(mixed(docs, mix).groupBy(*key).agg(F.count("*").alias("tm_taken")), "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("tm_row"), "doc_id", text_id(F.col("text")).alias("tm_text"))
    equal = rows.groupBy(*key).agg(F.count("*").alias("tm_equal")).where("tm_equal > 1")
    chosen = chosen.join(equal, [chosen.tm_id.eqNullSafe(equal.tm_id), chosen.tm_text2 == equal.tm_text2], "left").select(chosen.tm_id, chosen.tm_text2, "tm_taken", F.coalesce("tm_equal", F.lit(1)).alias("tm_equal"))
    taken = rows.join(stored(chosen, "taken"), (F.col("tm_text") == F.col("tm_text2")) & F.col("doc_id").eqNullSafe(F.col("tm_id")))
    among = F.row_number().over(Window.partitionBy("tm_text", "doc_id").orderBy(F.lit(1)))
    part = taken.where("tm_taken < tm_equal").withColumn("tm_place", among).where("tm_place <= tm_taken")
    return taken.where("tm_taken >= tm_equal").select("tm_row.*").unionByName(part.select("tm_row.*"))
