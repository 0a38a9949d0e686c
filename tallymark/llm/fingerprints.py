"""Document fingerprints as invertible Bloom lookup sketches (operator 2).

A text is cut into paragraphs (its lines; longer ones into pieces of PIECE code points). The digest of a paragraph mixes
60 bits of its MD5 with its number of occurrences. A sketch has three rows of cells; each digest is added to one cell of
each row, which holds a count, the XOR of its digests and the XOR of their check sums. Two versions' sketches subtract
cell by cell; a cell that holds a single digest gives it away, and taking that digest out of its other cells frees
further ones. When nothing can be freed although cells are left, the comparison is repeated with four times the cells.

The fingerprint is the sketch of BASE cells a row, so equal texts have equal fingerprints. A comparison begins by
subtracting the two fingerprints, whatever the texts' sizes: it is the difference that has to fit. Where it does not, the
sketches are made anew with GROWTH times the cells, until all differing digests are recovered. Likeness is shared / all
distinct digests, 1.0 for two empty texts.

Everything is joins, aggregates and expressions. Peeling frees one row of cells at a time, so that each digest is freed
by one cell only; since all rows of a document stay in one partition, the rounds need no shuffle. A digest has 20 bits for
each row of cells, so sketches end at LARGEST cells a row; a difference of millions of paragraphs, which does not fit
there, is taken from the digests themselves.

Defined results: a null text is empty; documents of equal doc_id are ordered by a digest of their text; rows with equal
doc_id and text count as one document and all get its result; a null doc_id comes last and is not that of an empty text id;
a lone document follows itself; a very long text is many paragraphs, compared like any other; columns beside doc_id and
text play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest60, stored

PIECE, BASE, GROWTH, LARGEST = 200, 8, 4, 1 << 20
PRIME = 4294967291
ROUNDS = 5
MASK60 = (1 << 60) - 1
#: Documents whose cells one task peels, about.
TOGETHER = 20_000


def paragraphs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PIECE), F.lit(0)), digest60)


def doc_key(doc_id: Column) -> Column:
    """doc_id as a text that differs from all others for null."""
    return F.coalesce(F.concat(F.lit("d"), doc_id.cast("string")), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, text): tm_doc, tm_text, text, tm_times."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), doc_key(F.col("doc_id")).alias("tm_doc"), digest60(text).alias("tm_text"))
    once = rows.groupBy("tm_doc", "tm_text").agg(F.first("text").alias("text"), F.count("*").alias("tm_times"))
    return once.where("tm_times > 0")  # true for all; both uses of this frame then read all its columns and share one shuffle


def in_order(docs: DataFrame) -> DataFrame:
    """tm_doc, tm_text, tm_seq, tm_next (the tm_seq that follows, in descending order of doc_id) and n_chars, stored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select("doc_id", doc_key(F.col("doc_id")).alias("tm_doc"), digest60(text).alias("tm_text"), F.length(text).cast("long").alias("n_chars")).distinct()
    order = [F.desc_nulls_last("doc_id"), F.asc("tm_text")]
    ranked = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = stored(ranked.withColumn("tm_seq", F.monotonically_increasing_id()), "order")
    # One row a partition, so of bounded size: numbers run on within a partition and jump to the next.
    ends = [r[:2] for r in ranked.groupBy(F.shiftright("tm_seq", 33)).agg(F.min("tm_seq"), F.max("tm_seq")).select("min(tm_seq)", "max(tm_seq)").orderBy(F.col("min(tm_seq)")).collect()]
    jumps = [(last, ends[(i + 1) % len(ends)][0]) for i, (_, last) in enumerate(ends)]
    jump = F.broadcast(spark.createDataFrame(jumps, "tm_seq long, tm_jump long"))
    return ranked.join(jump, "tm_seq", "left").withColumn("tm_next", F.coalesce("tm_jump", F.col("tm_seq") + 1)).drop("tm_jump")


def versions(docs: DataFrame) -> DataFrame:
    """For each distinct document its edited text's hash and the paragraph digests of both texts, stored."""
    order, texts = in_order(docs), keyed(docs)
    follower = order.select(F.col("tm_seq").alias("tm_next"), F.col("tm_doc").alias("tm_doc2"), F.col("tm_text").alias("tm_text2"))
    pairs = order.join(follower, "tm_next").withColumn("tm_need", F.floor(F.col("n_chars") / 3).cast("int"))
    source = texts.select(F.col("tm_doc").alias("tm_doc2"), F.col("tm_text").alias("tm_text2"), F.col("text").alias("tm_other"))
    heads = pairs.join(source, ["tm_doc2", "tm_text2"]).select("tm_doc", "tm_text", "tm_seq", "tm_next", "n_chars", "tm_need", F.expr("substring(tm_other, 1, tm_need)").alias("tm_head"))
    both = texts.join(heads, ["tm_doc", "tm_text"])
    both = both.withColumn("tm_edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - tm_need)"), "tm_head"))
    doc_id = F.when(F.col("tm_doc") != "", F.expr("substring(tm_doc, 2)")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return stored(
        both.select("tm_seq", "tm_next", "tm_times", doc_id, "n_chars", F.sha2("tm_edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("tm_own"), paragraphs(F.col("tm_edited")).alias("tm_edit")),
        "versions",
    )


def together(rows: DataFrame) -> DataFrame:
    """rows, which are stored, with all those of a document in one partition. The number of partitions follows the rows,
    as cells take many times the room of the arrays that the shuffle measures."""
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // TOGETHER)), "tm_seq")


def places(digest: Column, size: Column) -> list[Column]:
    """The cell of digest in each of the three rows."""
    return [t * size + F.shiftrightunsigned(digest, 20 * t).bitwiseAND(size - 1) for t in range(3)]


def sketched(items: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of items (keys, tm_size, tm_sign, tm_hash: a row for each paragraph, null for none), with keys, tm_size,
    tm_out false, tm_cell, tm_n, tm_key, tm_check; a row with tm_out true and tm_cell -1 stands for the key itself."""
    digests = items.groupBy(*keys, "tm_size", "tm_sign", "tm_hash").agg(F.count("*").alias("tm_c"))
    digest = (F.col("tm_hash") + (F.col("tm_c") - 1) * 1000000007).bitwiseAND(F.lit(MASK60))
    digests = digests.select(*keys, "tm_size", "tm_sign", F.when(F.col("tm_sign") != 0, digest).alias("tm_key"))
    at = F.when(F.col("tm_sign") != 0, F.array(*places(F.col("tm_key"), F.col("tm_size")))).otherwise(F.array(F.lit(-1).cast("long")))
    rows = digests.select(*keys, "tm_size", "tm_sign", "tm_key", F.explode(at).alias("tm_cell"))
    return rows.groupBy(*keys, "tm_size", "tm_cell").agg(
        F.sum("tm_sign").alias("tm_n"), F.coalesce(F.bit_xor("tm_key"), F.lit(0)).alias("tm_key"), F.coalesce(F.bit_xor(F.col("tm_key") % PRIME), F.lit(0)).alias("tm_check")
    ).withColumn("tm_out", F.col("tm_cell") < 0)


def freed(cells: DataFrame, keys: list[str], row: int, name: bool) -> DataFrame:
    """cells after the digests that lie alone in a cell of the given row went into rows with tm_out true: tm_cell is the
    digest if name, else they are only counted, under -2 for those of the first version and -3 for those of the second."""
    where = places(F.col("tm_key"), F.col("tm_size"))
    alone = ~F.col("tm_out") & (F.abs("tm_n") == 1) & (F.col("tm_key") % PRIME == F.col("tm_check")) & (F.col("tm_cell") == where[row])
    put = lambda out, cell, n, key, check: F.struct(out.alias("tm_out"), cell.alias("tm_cell"), n.alias("tm_n"), key.alias("tm_key"), check.alias("tm_check"))
    n, key, check, zero = F.col("tm_n"), F.col("tm_key"), F.col("tm_check"), F.lit(0).cast("long")
    gone = [put(F.lit(False), where[t], -n, key, check) for t in range(3) if t != row] + [put(F.lit(True), key if name else F.when(n > 0, F.lit(-2)).otherwise(F.lit(-3)).cast("long"), n, zero, zero)]
    stay = F.array(put(F.col("tm_out"), F.col("tm_cell"), n, key, check))
    moved = cells.select(*keys, "tm_size", F.inline(F.when(alone, F.array(*gone)).otherwise(stay)))
    summed = moved.groupBy(*keys, "tm_size", "tm_out", "tm_cell").agg(F.sum("tm_n").alias("tm_n"), F.bit_xor("tm_key").alias("tm_key"), F.bit_xor("tm_check").alias("tm_check"))
    return summed.where(F.col("tm_out") | (F.col("tm_n") != 0) | (F.col("tm_key") != 0) | (F.col("tm_check") != 0))


def resolved(pairs: DataFrame, name: bool) -> DataFrame:
    """The cells that are left of the pairs' differences after peeling, and what was freed, as freed() says."""
    keys = ["tm_seq", "tm_kind"]
    signed = lambda a, sign: F.transform(a, lambda h: F.struct(F.lit(sign).alias("tm_sign"), h.alias("tm_hash")))
    mark = F.array(F.struct(F.lit(0).alias("tm_sign"), F.lit(None).cast("long").alias("tm_hash")))
    items = pairs.select(*keys, "tm_size", F.inline(F.concat(signed("tm_a", 1), signed("tm_b", -1), mark)))
    cells = sketched(items, keys)
    cells = cells.where(F.col("tm_out") | (F.col("tm_n") != 0) | (F.col("tm_key") != 0) | (F.col("tm_check") != 0))
    for k in range(3 * ROUNDS):
        cells = freed(cells, keys, k % 3, name)
    return cells


def peeled(pairs: DataFrame) -> DataFrame:
    """pairs: tm_seq, tm_kind, tm_size and two arrays tm_a, tm_b of paragraph hashes. Gives tm_seq, tm_kind, tm_size,
    tm_left (cells that could not be resolved), tm_less and tm_more (number of digests of tm_a and of tm_b only)."""
    summed = lambda cell: F.abs(F.coalesce(F.sum(F.when(F.col("tm_cell") == cell, F.col("tm_n"))), F.lit(0)))
    return resolved(pairs, False).groupBy("tm_seq", "tm_kind", "tm_size").agg(F.count_if(~F.col("tm_out")).alias("tm_left"), summed(-2).alias("tm_less"), summed(-3).alias("tm_more"))


def differing_digests(pairs: DataFrame) -> DataFrame:
    """tm_seq, tm_kind, digest and side (1: of tm_a only, -1: of tm_b only) recovered from the sketches' difference."""
    return resolved(pairs, True).where("tm_out and tm_cell >= 0 and tm_n <> 0").select("tm_seq", "tm_kind", F.col("tm_cell").alias("digest"), F.signum("tm_n").cast("int").alias("side"))


def likeness(pairs: DataFrame) -> DataFrame:
    """pairs: tm_seq, tm_kind ("e" or "n"), tm_a, tm_b, partitioned by tm_seq. Gives tm_seq, tm_kind, tm_near."""
    todo, done = pairs.withColumn("tm_size", F.lit(BASE).cast("long")), []
    while True:
        found = peeled(todo).select(F.col("tm_seq").alias("tm_seq2"), F.col("tm_kind").alias("tm_kind2"), "tm_left", "tm_less", "tm_more")
        # both sides are partitioned by tm_seq, so the kind is left out of the join's keys
        both = todo.join(found, (F.col("tm_seq") == F.col("tm_seq2")) & F.concat("tm_kind", "tm_kind2").isin("ee", "nn"))
        again = lambda c: F.when(F.col("tm_left") > 0, F.col(c)).alias(c)
        own = F.array_size(F.array_distinct("tm_a")).alias("tm_na")
        found = stored(both.select("tm_seq", "tm_kind", "tm_size", "tm_left", "tm_less", "tm_more", own, again("tm_a"), again("tm_b")), "peeled")
        done.append(found.where("tm_left = 0"))
        failed = found.where("tm_left > 0").withColumn("tm_size", F.col("tm_size") * GROWTH).select("tm_seq", "tm_kind", "tm_size", "tm_a", "tm_b", "tm_na")
        if failed.isEmpty():
            break
        missing = lambda a, b: F.size(F.array_except(a, b)).cast("long")
        over = failed.where(F.col("tm_size") > LARGEST)
        done.append(over.withColumns({"tm_less": missing("tm_a", "tm_b"), "tm_more": missing("tm_b", "tm_a")}))
        todo = together(failed.where(F.col("tm_size") <= LARGEST).drop("tm_na"))
    columns = ("tm_seq", "tm_kind", "tm_na", "tm_less", "tm_more")
    all_done = done[0].select(*columns)
    for d in done[1:]:
        all_done = all_done.unionByName(d.select(*columns))
    total = F.col("tm_na") + F.col("tm_more")
    near = F.when(total == 0, F.lit(1.0)).otherwise((F.col("tm_na") - F.col("tm_less")) / total)
    return all_done.select("tm_seq", "tm_kind", near.alias("tm_near"))


def printed(rows: DataFrame) -> DataFrame:
    """rows: tm_seq, tm_own, tm_edit, partitioned by tm_seq. Gives tm_seq and both fingerprints as hex strings."""
    of = lambda a, kind: F.transform(a, lambda h: F.struct(F.lit(kind).alias("tm_kind"), F.lit(1).alias("tm_sign"), h.alias("tm_hash")))
    mark = F.array(*(F.struct(F.lit(k).alias("tm_kind"), F.lit(0).alias("tm_sign"), F.lit(None).cast("long").alias("tm_hash")) for k in "ef"))
    items = rows.select("tm_seq", F.lit(BASE).cast("long").alias("tm_size"), F.inline(F.concat(of("tm_own", "f"), of("tm_edit", "e"), mark)))
    cells = sketched(items, ["tm_seq", "tm_kind"]).where(~F.col("tm_out"))
    digits = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    text = F.concat(digits(F.col("tm_n"), 4), digits(F.col("tm_key"), 15), digits(F.col("tm_check"), 8))
    cell = F.struct(F.col("tm_cell").alias("c"), text.alias("t"))
    own = cells.groupBy("tm_seq").agg(F.collect_list(F.when(F.col("tm_kind") == "f", cell)).alias("tm_f"), F.collect_list(F.when(F.col("tm_kind") == "e", cell)).alias("tm_e"))
    flat = lambda c: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3 * BASE - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.map_from_entries(c), i), F.lit("0" * 27))), "")
    return own.select("tm_seq", flat(F.col("tm_f")).alias("fingerprint"), flat(F.col("tm_e")).alias("edited_fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    rows = versions(docs.select("doc_id", "text"))
    following = rows.select(F.col("tm_seq").alias("tm_next"), F.col("tm_own").alias("tm_after"))
    slim = stored(rows.join(following, "tm_next").select("tm_seq", "tm_own", "tm_edit", "tm_after"), "digests")
    both = F.array(F.struct(F.lit("e").alias("tm_kind"), F.col("tm_edit").alias("tm_b")), F.struct(F.lit("n").alias("tm_kind"), F.col("tm_after").alias("tm_b")))
    pairs = together(slim).select("tm_seq", F.col("tm_own").alias("tm_a"), F.inline(both))
    near = likeness(pairs).groupBy("tm_seq").agg(F.max(F.when(F.col("tm_kind") == "e", F.col("tm_near"))).alias("near_edited"), F.max(F.when(F.col("tm_kind") == "n", F.col("tm_near"))).alias("near_next"))
    shown = printed(together(slim.select("tm_seq", "tm_own", "tm_edit")))
    facts = rows.select("tm_seq", "tm_times", "doc_id", "n_chars", "edited_sha256")
    out = facts.join(near, "tm_seq").join(shown, "tm_seq", "left")
    blank = F.lit("0" * (27 * 3 * BASE))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", blank).alias("fingerprint"), F.coalesce("edited_fingerprint", blank).alias("edited_fingerprint"),
        "near_edited", "near_next", F.explode(F.sequence(F.lit(1).cast("long"), F.col("tm_times"))).alias("tm_copy"),
    ).drop("tm_copy")
