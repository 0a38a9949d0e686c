"""Product identification: exact article number, then brand or text similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import nonblank, windows
from ..functions.text import let, once
from ..storage import stored

THRESHOLD, PREFIX = 0.72, 200
BRAND_AND_NAME, BRAND_ONLY = 0.85, 0.6
#: A catalogue is broadcast only up to this many rows; a larger one is joined on its keys by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if counting it up to the limit shows that it is small. Otherwise with one against it: Spark
    goes by the size of compressed files, so a table of many short rows would go to the driver all the same."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def by_barcode(scans: DataFrame, products: DataFrame) -> DataFrame:
    """scan_id, reference_product_id of scans whose barcode is that of a product, the first of equals in the catalogue."""
    order = Window.partitionBy("tm_code").orderBy("catalogue_pos")
    unique = products.select(nonblank(F.col("barcode")).alias("tm_code"), "reference_product_id", "catalogue_pos").where("tm_code is not null")
    unique = unique.withColumn("tm_rank", F.row_number().over(order)).where("tm_rank = 1").select("tm_code", "reference_product_id")
    return scans.select("scan_id", nonblank(F.col("barcode")).alias("tm_code")).join(small(unique), "tm_code").select("scan_id", "reference_product_id")


def with_brand(scans: DataFrame, products: DataFrame, few: int = 1_000) -> DataFrame:
    """scans with brand: the first brand in alphabetic order that the text contains, whatever the case, or null.

    A few brands go to all scans as one sorted array, without a shuffle. Many are found by an equi-join of their first
    letters with the text's distinct windows of that length, which holds every hit; only these are held against the text.
    """
    brands = products.select(nonblank(F.col("brand")).alias("brand")).where("brand is not null").distinct()
    if brands.limit(few + 1).count() <= few:
        listed = brands.agg(F.array_sort(F.collect_list(F.struct("brand", F.lower("brand").alias("low")))).alias("tm_brands"))  # one row of few brands at most
        hit = lambda low: F.get(F.filter("tm_brands", lambda b: F.contains(low, b["low"])), F.lit(0))["brand"]
        return once(scans.crossJoin(F.broadcast(listed)), brand=let(F.lower("text"), hit)).drop("tm_brands")
    text = scans.select("scan_id", F.lower("text").alias("tm_text"))
    size = F.least(F.lit(3), F.length("brand"))
    keyed = brands.withColumn("tm_gram", F.substring(F.lower("brand"), F.lit(1), size))
    grams = F.array_distinct(F.flatten(F.array(*(windows(F.col("tm_text"), n) for n in (1, 2, 3)))))
    hits = text.withColumn("tm_gram", F.explode(grams)).join(keyed, "tm_gram").where(F.contains("tm_text", F.lower("brand")))
    return scans.join(hits.groupBy("scan_id").agg(F.min("brand").alias("brand")), "scan_id", "left")


def known_brand(scans: DataFrame, products: DataFrame, few: int = 1_000) -> DataFrame:
    """scan_id, brand of the scans whose text holds a known brand."""
    return with_brand(scans.select("scan_id", "text"), products, few).select("scan_id", "brand").where("brand is not null")


#: Code points of an index gram.
GRAM = 6


def name_index(products: DataFrame) -> DataFrame:
    """An inverted index of product names, to be stored where it has several users: tm_brand, tm_gram, tm_size, tm_name and
    tm_first (catalogue_pos, reference_product_id), one row for each distinct name of a brand, all lower case.

    tm_gram is the hash of the name's gram (GRAM code points, or the whole of a shorter name, tm_size) that fewest names of
    the brand have. A text that holds a name holds this gram as well, so only names whose rarest gram is in a text have to
    be compared with it, however many names a brand has.
    """
    names = products.select(F.lower("brand").alias("tm_brand"), F.lower("product_name").alias("tm_name"), "catalogue_pos", "reference_product_id").where("tm_brand <> '' and tm_name <> ''")
    first = names.groupBy("tm_brand", "tm_name").agg(F.min(F.struct("catalogue_pos", "reference_product_id")).alias("tm_first"))
    size = F.least(F.length("tm_name"), F.lit(GRAM))
    each = first.withColumn("tm_size", size).withColumn("tm_gram", F.explode(gram_hashes(F.col("tm_name"), [GRAM], whole_below=GRAM)))
    often = each.groupBy("tm_brand", "tm_gram").agg(F.count("*").alias("tm_names"))
    best = F.min_by(F.struct("tm_gram", "tm_size", "tm_first"), F.struct("tm_names", "tm_gram"))
    return each.join(often, ["tm_brand", "tm_gram"]).groupBy("tm_brand", "tm_name").agg(best.alias("tm_best")).select("tm_brand", "tm_name", "tm_best.*")


def gram_hashes(text: Column, sizes: list[int], whole_below: int = 0) -> Column:
    """Hashes of the distinct substrings of text of the given sizes; of a text shorter than whole_below, of itself."""
    hashed = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    found = F.array_distinct(F.flatten(F.array(*(hashed(windows(text, n)) for n in sizes))))
    return F.when(F.length(text) < whole_below, F.array(F.xxhash64(text))).otherwise(found) if whole_below else found


def name_probes(scans: DataFrame, index: DataFrame) -> DataFrame:
    """scan_id, tm_name, tm_first, tm_text: the names of each scan's brand whose rarest gram its text holds."""
    sizes = [r[0] for r in index.select("tm_size").distinct().collect()]  # GRAM values at most
    if not sizes:
        return scans.limit(0).select("scan_id", F.lit("").alias("tm_name"), F.struct(F.lit(0).cast("long").alias("catalogue_pos"), F.lit("").alias("reference_product_id")).alias("tm_first"), F.lit("").alias("tm_text"))
    text = once(scans.select("scan_id", "text", F.lower("brand").alias("tm_brand")).where("tm_brand <> ''"), tm_text=F.lower("text")).drop("text")
    probes = text.withColumn("tm_gram", F.explode(gram_hashes(F.col("tm_text"), sorted(sizes))))
    names = index.select("tm_brand", "tm_gram", "tm_name", "tm_first")
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return probes.join(F.broadcast(names), ["tm_brand", "tm_gram"]).select("scan_id", "tm_name", "tm_first", "tm_text")
    found = probes.drop("tm_text").join(names, ["tm_brand", "tm_gram"]).select("scan_id", "tm_name", "tm_first")  # texts do not go with every gram
    return found.join(text.select("scan_id", "tm_text"), "scan_id").select("scan_id", "tm_name", "tm_first", "tm_text")


def by_name(scans: DataFrame, products: DataFrame, index: DataFrame | None = None, few: int = 500) -> DataFrame:
    """scan_id, reference_product_id, catalogue_pos of the first product of a scan's brand whose name is in its text. A name
    without letters is in every text.

    A text of a brand of few names is searched for each of them, which costs less than its grams; others probe the index."""
    index = stored(name_index(products), "names") if index is None else index
    listed = index.groupBy("tm_brand").agg(F.collect_list(F.struct("tm_name", "tm_first")).alias("tm_names"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and listed.where(F.size("tm_names") > few).isEmpty():
        own = scans.select("scan_id", F.lower("text").alias("tm_text"), F.lower("brand").alias("tm_brand")).join(F.broadcast(listed), "tm_brand")
        hit = F.filter("tm_names", lambda x: F.contains(F.col("tm_text"), x["tm_name"]))
        held = once(own, tm_first=F.array_min(F.transform(hit, lambda x: x["tm_first"]))).where("tm_first is not null").select("scan_id", "tm_first")
    else:
        held = name_probes(scans, index).where(F.contains("tm_text", "tm_name")).select("scan_id", "tm_first")
    blank = products.where("product_name = ''").groupBy(F.lower("brand").alias("tm_brand")).agg(F.min(F.struct("catalogue_pos", "reference_product_id")).alias("tm_first"))
    nameless = scans.select("scan_id", F.lower("brand").alias("tm_brand"), "text").where("text is not null").join(small(blank), "tm_brand").select("scan_id", "tm_first")
    found = held.unionByName(nameless).groupBy("scan_id").agg(F.min("tm_first").alias("tm_first"))
    return found.select("scan_id", "tm_first.reference_product_id", "tm_first.catalogue_pos")


def by_brand(scans: DataFrame, products: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """scan_id, reference_product_id, score for scans (scan_id, text, brand) with a guessed brand: 0.85 for the first product
    of that brand whose name is in the text, else 0.6 for the brand's first product, which is one row a brand."""
    first = products.select(F.lower("brand").alias("tm_brand"), "catalogue_pos", "reference_product_id").where("tm_brand <> ''")
    first = first.groupBy("tm_brand").agg(F.min_by("reference_product_id", "catalogue_pos").alias("tm_first"))
    own = scans.select("scan_id", F.lower("brand").alias("tm_brand")).join(small(first), "tm_brand")
    both = own.join(by_name(scans, products, index).select("scan_id", F.col("reference_product_id").alias("tm_named")), "scan_id", "left")
    score = F.when(F.col("tm_named").isNotNull(), BRAND_AND_NAME).otherwise(BRAND_ONLY)
    return both.select("scan_id", F.coalesce("tm_named", "tm_first").alias("reference_product_id"), score.alias("score"))


def similarity(a: Column, b: Column) -> Column:
    """2 M / T of the longest matching blocks, lower case. Built-in distances differ, so Arrow batches go to Python."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:  # local, so that it travels to the workers by value
        return pd.Series([SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratios, T.DoubleType())(a, b)


def numbered_signs(c: Column) -> Column:
    """The signs of c, each with the number of its occurrences so far, so that no two are equal: a bag as a set."""
    signs = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)))
    return let(signs, lambda a: F.transform(a, lambda x, i: F.concat(x, F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))


def least_common(n: Column, m: Column) -> Column:
    """Signs that texts of n and m signs have in common at least if their ratio reaches THRESHOLD."""
    return F.ceil((n + m) * (THRESHOLD / 2) - 1e-9).cast("int")


REACH = (2 - THRESHOLD) / THRESHOLD


def rare_first(rows: DataFrame, keys: list[str], often: DataFrame) -> DataFrame:
    """rows (keys, tm_signs) with tm_signs in the order of often, the rarest first."""
    each = rows.select(*keys, F.explode("tm_signs").alias("tm_sign")).join(small(often), "tm_sign")
    sets = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tm_often", "tm_sign"))).alias("tm_signs"))
    return sets.withColumn("tm_signs", F.transform("tm_signs", lambda x: x["tm_sign"]))


def similar_pairs(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (tm_text, tm_label and the other keys) whose signs alone do not rule a ratio of THRESHOLD out.

    The ratio is 2 M / (n + m), and M is at most the number of signs in common. Two sets that have so many in common share
    one among the n - least + 1 first of the one and the m - least + 1 first of the other, in any one order, so these
    prefixes are joined; with the rarest signs first they meet seldom. The place where they meet bounds what may follow
    (positional filter), and the sets themselves decide. texts: tm_own, tm_text; labels: tm_label, tm_brand, tm_first.
    """
    signs = lambda c: numbered_signs(F.lower(c))
    label = once(labels, tm_signs=signs(F.col("tm_label"))).withColumn("tm_m", F.size("tm_signs")).where("tm_m > 0")
    reach = label.agg(F.min("tm_m").alias("tm_low"), F.max("tm_m").alias("tm_high"))  # one row
    text = texts.withColumn("tm_n", F.length(F.lower("tm_text"))).join(F.broadcast(reach)).where((F.col("tm_low") <= F.col("tm_n") * REACH) & (F.col("tm_n") <= F.col("tm_high") * REACH))
    text = stored(once(text, tm_signs=signs(F.col("tm_text"))).withColumn("tm_n", F.size("tm_signs")), "short-texts")
    label = stored(label.join(F.broadcast(text.agg(F.min("tm_n").alias("tm_least")))), "labels")  # one row
    often = text.select(F.explode("tm_signs").alias("tm_sign")).unionByName(label.select(F.explode("tm_signs").alias("tm_sign"))).groupBy("tm_sign").agg(F.count("*").alias("tm_often"))
    left = rare_first(text, ["tm_own", "tm_text", "tm_n", "tm_low"], often)
    right = rare_first(label, ["tm_label", "tm_brand", "tm_first", "tm_m", "tm_least"], often)
    shortest = lambda n, low: F.greatest(F.ceil(n / REACH - 1e-9).cast("int"), low)
    head = lambda n, low: F.greatest(n - least_common(n, shortest(n, low)) + 1, F.lit(0))
    left = left.withColumnRenamed("tm_signs", "tm_a").select("*", F.posexplode(F.slice("tm_a", F.lit(1), head(F.col("tm_n"), F.col("tm_low")))).alias("tm_i", "tm_sign"))
    right = right.withColumnRenamed("tm_signs", "tm_b").select("*", F.posexplode(F.slice("tm_b", F.lit(1), head(F.col("tm_m"), F.col("tm_least")))).alias("tm_j", "tm_sign"))
    wanted = least_common(F.col("tm_n"), F.col("tm_m"))
    rest = F.least(F.col("tm_n") - F.col("tm_i"), F.col("tm_m") - F.col("tm_j"))  # this sign and those behind it
    met = left.join(right, "tm_sign").where((wanted <= F.least("tm_n", "tm_m")) & (rest >= wanted) & ~F.coalesce(F.col("tm_own") == F.col("tm_brand"), F.lit(False)))
    return met.where(F.size(F.array_intersect("tm_a", "tm_b")) >= wanted).select("tm_own", "tm_text", "tm_label", "tm_first").distinct()


def by_similarity(scans: DataFrame, products: DataFrame) -> DataFrame:
    """scan_id, reference_product_id, score of the most similar product at or above THRESHOLD, the first of equals.

    Distinct texts meet distinct labels by the prefixes of their rare signs (similar_pairs); a text that is too long for
    every label, as most are, meets none. Only pairs that the signs leave open go to Python. A guessed brand's products
    are scored by by_brand, so a scan's own brand makes no pair.
    """
    own = F.lower("brand") if "brand" in scans.columns else F.lit(None).cast("string")
    label = products.select("reference_product_id", "catalogue_pos", F.lower("brand").alias("tm_brand"), F.concat_ws(" ", F.col("brand"), F.col("product_name")).alias("tm_label"))
    label = label.groupBy("tm_label", "tm_brand").agg(F.min(F.struct("catalogue_pos", "reference_product_id")).alias("tm_first"))
    text = scans.select("scan_id", own.alias("tm_own"), F.substring("text", 1, PREFIX).alias("tm_text")).where("tm_text <> ''")
    pairs = similar_pairs(text.select("tm_own", "tm_text").distinct(), label)
    pairs = pairs.withColumn("score", similarity(F.col("tm_label"), F.col("tm_text"))).where(F.col("score") >= THRESHOLD)
    best = F.max_by(F.struct("tm_first.reference_product_id", "score"), F.struct("score", -F.col("tm_first.catalogue_pos")))
    found = pairs.groupBy(F.col("tm_own").alias("tm_own2"), F.col("tm_text").alias("tm_text2")).agg(best.alias("tm_best"))
    named = text.join(found, (F.col("tm_text") == F.col("tm_text2")) & F.col("tm_own").eqNullSafe(F.col("tm_own2")))
    return named.select("scan_id", "tm_best.reference_product_id", F.bround("tm_best.score", 3).alias("score"))


def matched(scans: DataFrame, products: DataFrame, fuzzy: bool = True) -> DataFrame:
    """scans (scan_id, text, barcode, brand) with reference_found, reference_product_id, match_method, match_score.

    Barcode hits come first; only the rest go on. The best of brand and similarity counts.
    """
    exact = by_barcode(scans, products).select("scan_id", "reference_product_id", F.lit("barcode").alias("match_method"), F.lit(1.0).alias("match_score"))
    rest = scans.select("scan_id", "text", "brand").join(exact.hint("merge"), "scan_id", "left_anti")  # grows with the scans
    named = by_name(rest.where("brand is not null"), products)  # a brand alone scores below THRESHOLD
    branded = named.select("scan_id", "reference_product_id", F.lit(BRAND_AND_NAME).alias("score"))
    if fuzzy:
        place = small(products.select("reference_product_id", "catalogue_pos"))
        scored = branded.unionByName(by_similarity(rest, products)).join(place, "reference_product_id")
        best = F.max_by(F.struct("reference_product_id", "score"), F.struct("score", -F.col("catalogue_pos"))).alias("b")
        branded = scored.groupBy("scan_id").agg(best).select("scan_id", "b.reference_product_id", "b.score")
    found = exact.unionByName(branded.select("scan_id", "reference_product_id", F.lit("fuzzy").alias("match_method"), F.col("score").alias("match_score")))
    both = scans.join(found.hint("merge"), "scan_id", "left")
    return both.withColumn("reference_found", F.col("reference_product_id").isNotNull()).withColumn("match_score", F.coalesce("match_score", F.lit(0.0)))


def prefer(reference: Column, extracted: Column) -> Column:
    """The reference's value unless missing or empty, else what was extracted."""
    return F.coalesce(F.nullif(reference, F.lit("")), F.nullif(extracted, F.lit("")))
