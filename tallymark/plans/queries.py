"""Query registry: for each operator a Spark query over the derived views and, where SQL can say it, its DuckDB twin.

The twins are written apart from the Column code: lines become rows, cascades become ranked unions.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import barcode, compare, extract, match, ocr, rules, vision
from ..sources import buckets, constraints, headers, layout, sinks
from ..storage import fresh, stored
from . import pipeline, runs
from .fixtures import VIEWS, oracle_view, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF = datetime.date(2024, 6, 30)


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with its twin over the given views."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [f"{v} AS MATERIALIZED ({oracle_view(v)})" if v in VIEWS else v for v in views]
            ORACLE[f.__name__] = (f"WITH {', '.join(parts)} " if parts else "") + sql
        return f

    return keep


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORMAL = r"regexp_replace(regexp_replace(replace(text, '₹', ' ₹ '), '[ \t]+', ' ', 'g'), ' *([:/]) *', '\1', 'g')"
LINES = f"L AS MATERIALIZED (SELECT scan_id, i, trim(s[i]) AS line, trim(s[i + 1]) AS n1, trim(s[i + 2]) AS n2, trim(s[i + 3]) AS n3 FROM (SELECT scan_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT scan_id, string_split({NORMAL}, chr(10)) AS s FROM label_scans WHERE text IS NOT NULL)))"
MAJOR = "(?i)" + text.MAJOR.replace("(?i)", "")


def fields(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return extract.raw_fields(view(spark, sf_dir, "label_scans"), F.lit(AS_OF), only or None)


def field(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows that have the field. The generator drops the others, as a filter on the column would compute it twice."""
    return fields(spark, sf_dir, name).select("scan_id", F.explode(F.array_compact(F.array(name))).alias(name))


# --- sources, filters, projections


_VALID_ON = "coalesce(is_active, true) AND (effective_from IS NULL OR effective_from <= DATE '2024-06-30') AND (effective_to IS NULL OR effective_to >= DATE '2024-06-30')"


@query(f"SELECT rule_code, field_name, operator, severity FROM rule_book WHERE {_VALID_ON}", "rule_book")
def rules_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.active(view(spark, sf_dir, "rule_book"), F.lit(AS_OF)).select("rule_code", "field_name", "operator", "severity")


@query(f"SELECT string_agg(version, ',' ORDER BY version) AS rules_version FROM (SELECT DISTINCT version FROM rule_book WHERE version <> '' AND {_VALID_ON})", "rule_book")
def rules_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_version(rules.active(view(spark, sf_dir, "rule_book"), F.lit(AS_OF)))


@query("SELECT reference_product_id, brand, product_name FROM products WHERE contains(lower(brand), 'a') OR contains(lower(product_name), 'a')", "products")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    needle = F.lower(F.trim(F.lit(" A ")))
    return view(spark, sf_dir, "products").where(F.contains(F.lower("brand"), needle) | F.contains(F.lower("product_name"), needle)).select("reference_product_id", "brand", "product_name")


@query("SELECT reference_product_id, brand, product_name, mrp FROM products WHERE reference_product_id = 'ref-17'", "products")
def product_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "products").where("reference_product_id = 'ref-17'").select("reference_product_id", "brand", "product_name", "mrp").limit(1)


@query("SELECT DISTINCT brand FROM products WHERE brand <> ''", "products")
def brands_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "products").where("brand <> ''").select("brand").distinct()


@query("SELECT count(*) FILTER (starts_with(source_note, 'PLACEHOLDER')) AS placeholders, count(*) AS products FROM products", "products")
def placeholder_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "products").agg(F.count_if(F.startswith("source_note", F.lit("PLACEHOLDER"))).alias("placeholders"), F.count("*").alias("products"))


@query("SELECT cast(event_id AS varchar) AS scan_id, ts AS created_at, '' AS product_name, user_id % 3 <> 0 AS reference_found, event_type AS compliance_status FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = F.when(F.col("user_id") % 3 == 0, "").otherwise("ref")
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("detected_product_name"), reference.alias("reference_product_id"), F.col("event_type").alias("status"))
    return sinks.history(records)


@query("SELECT o_orderkey AS scan_id, o_orderstatus AS status FROM orders WHERE o_orderkey = 33")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 33").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("status")).limit(1)


# --- extraction

_AMOUNT = "length(regexp_replace(v, '[^0-9]', '', 'g')) <= 6"


@query(
    f"""SELECT scan_id, coalesce(arg_min(v, i) FILTER (cur), arg_min(v, i)) AS mrp_raw FROM (SELECT * FROM A UNION ALL SELECT * FROM B WHERE scan_id NOT IN (SELECT scan_id FROM A)) GROUP BY scan_id""",
    "label_scans", LINES,
    rf"A AS (SELECT * FROM (SELECT scan_id, i, regexp_replace(regexp_extract(line, {q(extract.MRP_LINE)}, 2), '([.,])\s+', '\1') AS v, regexp_extract(line, {q(extract.MRP_LINE)}, 1) <> '' AS cur FROM L WHERE regexp_matches(line, {q(extract.MRP_LINE)})) WHERE {_AMOUNT})",
    f"B AS (SELECT * FROM (SELECT scan_id, i, regexp_extract(n1, {q('(?i)' + extract.MRP_VALUE.replace('(?i)', ''))}, 2) AS v, regexp_extract(n1, {q('(?i)' + extract.MRP_VALUE.replace('(?i)', ''))}, 1) <> '' AS cur FROM L WHERE regexp_matches(line, '(?i)^(?:mrp|m\\.r\\.p)[.:=\\-]?$') AND n1 IS NOT NULL AND NOT regexp_matches(n1, {q(MAJOR)})) WHERE v <> '' AND {_AMOUNT})",
)
def mrp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "mrp_raw")


_QTY = extract.QUANTITY


@query(
    "SELECT scan_id, coalesce(min(beside), min(near)) AS net_quantity_raw FROM (SELECT scan_id, arg_min(v, i) AS beside, NULL AS near FROM A GROUP BY scan_id UNION ALL SELECT scan_id, NULL, arg_min(v, i) FROM B GROUP BY scan_id) GROUP BY scan_id",
    "label_scans", LINES,
    rf"A AS (SELECT scan_id, i, regexp_extract(line, {q('(?i)' + extract.NET_LABEL + r'[:\s.]*(' + _QTY + ')')}, 1) AS v FROM L WHERE regexp_matches(line, {q('(?i)' + extract.NET_LABEL + r'[:\s.]*(' + _QTY + ')')}))",
    rf"B AS (SELECT scan_id, i, n1 AS v FROM L WHERE regexp_matches(line, {q('(?i)' + extract.NET_LABEL)}) AND regexp_full_match(n1, {q('(?i)' + _QTY)}) AND NOT regexp_matches(n1, {q(MAJOR)}))",
)
def net_quantity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "net_quantity_raw")


_UNIT_CASE = "CASE WHEN u IN ('g','gm','gms','gram','grams') THEN 'g' WHEN u IN ('kg','kgs') THEN 'kg' WHEN u = 'ml' THEN 'ml' WHEN u IN ('l','lt','ltr','litre','litres','liter') THEN 'l' ELSE nullif(u, '') END"


@query(
    f"SELECT catalogue_pos, value, {_UNIT_CASE} AS unit FROM P",
    "products",
    f"""P AS (SELECT catalogue_pos, try_cast(CASE WHEN len(vs) = 0 THEN NULL WHEN t <> '' THEN t ELSE vs[-1] END AS double) AS value, lower(CASE WHEN len(vs) = 0 THEN NULL WHEN t <> '' THEN coalesce(nullif(tu, ''), us[1]) ELSE us[-1] END) AS u FROM
    (SELECT catalogue_pos, regexp_extract_all(raw, {q(numbers.NUMBER_UNIT)}, 1) AS vs, regexp_extract_all(raw, {q(numbers.NUMBER_UNIT)}, 2) AS us, regexp_extract(raw, {q(numbers.TOTAL)}, 1) AS t, regexp_extract(raw, {q(numbers.TOTAL)}, 2) AS tu FROM
    (SELECT catalogue_pos, coalesce(net_weight, 'none') || CASE catalogue_pos % 4 WHEN 0 THEN ' + 20 gms extra = 120 g' WHEN 1 THEN ' / 1.5 Litre' WHEN 2 THEN ' = 7' ELSE '' END AS raw FROM products)))""",
)
def net_quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("catalogue_pos") % 4 == 0, " + 20 gms extra = 120 g").when(F.col("catalogue_pos") % 4 == 1, " / 1.5 Litre").when(F.col("catalogue_pos") % 4 == 2, " = 7").otherwise("")
    got = numbers.net_quantity(F.concat(F.coalesce("net_weight", F.lit("none")), tail))
    return view(spark, sf_dir, "products").select("catalogue_pos", got["value"].alias("value"), got["unit"].alias("unit"))


def _dates(label: str, column: str) -> tuple[str, ...]:
    d = q("(" + dates.DATE + ")")
    own = f"nullif(regexp_extract(regexp_extract(line, {q('(?i)' + label + '(.*)$')}, 1), {d}, 1), '')"
    near = f"coalesce({own}, nullif(regexp_extract(n1, {d}, 1), ''), CASE WHEN NOT regexp_matches(n2, {q(MAJOR)}) THEN nullif(regexp_extract(n2, {d}, 1), '') END)"
    return "label_scans", LINES, f"D AS (SELECT scan_id, arg_min(v, i) AS {column} FROM (SELECT scan_id, i, {near} AS v FROM L WHERE regexp_matches(line, {q('(?i)' + label)})) WHERE v IS NOT NULL GROUP BY scan_id)"


_YEAR = "CASE WHEN length(p[3]) = 2 THEN cast(p[3] AS int) + CASE WHEN cast(p[3] AS int) >= 69 THEN 1900 ELSE 2000 END ELSE cast(p[3] AS int) END"
_DAY = f"try_cast(lpad(cast({_YEAR} AS varchar), 4, '0') || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[1], 2, '0') AS date)"


@query(
    f"SELECT scan_id, packing_date_raw FROM (SELECT *, string_split_regex(regexp_replace(packing_date_raw, '\\s+', '', 'g'), '[/.\\-]') AS p FROM D) WHERE CASE WHEN len(p) < 3 THEN true ELSE coalesce({_DAY} <= DATE '2024-06-30', false) END",
    *_dates(extract.PACKED_LABEL, "packing_date_raw"),
)
def date_extract_pkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "packing_date_raw")


@query("SELECT * FROM D", *_dates(extract.USE_BY_LABEL, "use_by_raw"))
def date_extract_use_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "use_by_raw")


@query("SELECT * FROM D", *_dates(extract.BEST_BEFORE_LABEL, "best_before_raw"))
def date_extract_best_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "best_before_raw")


_DATE_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN '{d}/{m}/{yy}' WHEN 1 THEN '{d}-{m}-{y}' WHEN 2 THEN '{d}.{m}.{yy}' WHEN 3 THEN '31/02/24' ELSE 'soon' END"
_DATE_SQL = (
    "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%y') WHEN 3 THEN '31/02/24' ELSE 'soon' END"
)


@query(f"SELECT scan_id, cast({_DAY} AS varchar) AS iso FROM (SELECT o_orderkey AS scan_id, string_split_regex({_DATE_SQL}, '[/.\\-]') AS p FROM orders WHERE o_orderkey % 5 <> 4) UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 4")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    printed = F.when(k == 0, F.date_format(d, "d/M/yy")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "dd.MM.yy")).when(k == 3, "31/02/24").otherwise("soon")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), dates.parse_date(printed).alias("iso"))


_NOT = " AND ".join(f"NOT contains(lower(line), {q(p)})" for p in extract.NOT_COMPANY)
_MARK = " OR ".join(f"contains(' ' || upper(line) || ' ', {q(p)})" for p in extract.COMPANY_MARKERS)


@query(
    f"""SELECT scan_id, i AS line_no, coalesce(NOT regexp_matches(upper(line), {q(extract.COMPANY_CONTACT)}) AND ({_MARK}) AND {_NOT} AND length(line) >= 8 AND regexp_matches(line, '[A-Za-z]{{3}}') AND len(string_split(line, ' ')) >= 2
    AND NOT regexp_matches(regexp_replace(line, '(?i)\\s+(?:wt\\s*[-:]?\\s*)?\\d{{6}}\\s*$', ''), '\\d') AND NOT regexp_matches(line, '^[(\\[{{]') AND length(regexp_replace(line, '[A-Za-z0-9\\s&.,()\\-]', '', 'g')) < 2
    AND len(list_filter(string_split(lower(line), ' '), lambda w: length(trim(w, '.,()')) >= 3 AND trim(w, '.,()') NOT IN ('pvt', 'ltd', 'limited', 'private', 'llp', 'inc'))) > 0, false) AS valid FROM L WHERE line <> ''""",
    "label_scans", LINES,
)
def company_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.with_lines(view(spark, sf_dir, "label_scans")).select("scan_id", F.posexplode("tm_lines").alias("at", "line")).where("line <> ''")
    return rows.select("scan_id", (F.col("at") + 1).cast("long").alias("line_no"), extract.is_company(F.col("line")).alias("valid"))


_ADDRESS = " OR ".join(f"contains(lower(line), {q(p)})" for p in extract.ADDRESS_WORDS)


@query(f"SELECT scan_id, i AS line_no FROM L WHERE line <> '' AND ({_ADDRESS} OR regexp_matches(line, '\\b\\d{{6}}\\b') OR contains(line, ','))", "label_scans", LINES)
def address_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.with_lines(view(spark, sf_dir, "label_scans")).select("scan_id", F.posexplode("tm_lines").alias("at", "line")).where("line <> ''")
    return rows.where(extract.address_evidence(F.col("line"))).select("scan_id", (F.col("at") + 1).cast("long").alias("line_no"))


@query(
    r"""SELECT scan_id, coalesce(nullif(regexp_extract(t, '(?i)(?:^|\n)(?:mfd|manufactured|packed|marketed) by[ :]*\n?([^\n]*(?:limited|ltd)[^\n]*)', 1), ''), nullif(regexp_extract(t, '(?i)(?:^|\n)(?:mfd|manufactured|packed|marketed)\nby\n([^\n]*(?:limited|ltd)[^\n]*)', 1), ''),
    nullif(regexp_extract(t, '(?i)(?:^|\n)((?:at:)?[a-z ]*(?:limited|ltd))(?:\n|$)', 1), '')) AS maker_raw FROM (SELECT scan_id, """ + NORMAL + r""" AS t FROM label_scans WHERE text IS NOT NULL) WHERE regexp_matches(t, '(?i)\b(?:limited|ltd)\b')""",
    "label_scans",
)
def manufacturer_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "maker_raw")


@query()
def manufacturer_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir, "maker_raw", "address_raw", "maker_address_raw").select("scan_id", "maker_raw", "address_raw", "maker_address_raw")


def _whole(pattern: str, column: str) -> str:
    return f"SELECT scan_id, trim(regexp_extract(t, {q(pattern)}, 1)) AS {column} FROM (SELECT scan_id, {NORMAL} AS t FROM label_scans WHERE text IS NOT NULL) WHERE regexp_matches(t, {q(pattern)})"


@query(_whole(extract.CARE, "care_raw"), "label_scans")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "care_raw")


@query(_whole(extract.BATCH, "batch_raw"), "label_scans")
def batch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "batch_raw")


@query(_whole(extract.ORIGIN, "origin_raw"), "label_scans")
def country_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field(spark, sf_dir, "origin_raw")


@query("SELECT scan_id, CASE WHEN ocr_status = 'success' AND coalesce(zoom_text, '') <> '' AND NOT regexp_matches(text, '(?i)mfg|pkd|use by|best before') THEN text || chr(10) || zoom_text ELSE text END AS text FROM label_scans", "label_scans")
def zoom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.with_zoom(view(spark, sf_dir, "label_scans")).select("scan_id", "text")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


@query("SELECT doc_id, translate(text, 'OoIlS', '00115') AS digits, regexp_full_match(regexp_replace(regexp_replace(text, '[\\s()]', '', 'g'), '(?i)^(?:₹|rs\\.?|inr)', ''), '[0-9OoIlS.,/]+') AS numeric_like FROM documents")
def ocr_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.digits_for_letters(F.col("text")).alias("digits"), text.looks_numeric(F.col("text")).alias("numeric_like"))


@query("SELECT scan_id, regexp_replace(text, '(?i)\\b(?:rs\\.|rs\\b|inr\\b)', '₹', 'g') AS marked FROM label_scans", "label_scans")
def currency_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "label_scans").select("scan_id", text.rupee_prefix(F.col("text")).alias("marked"))


@query("SELECT doc_id, coalesce(nullif(right(regexp_replace(replace(trim(text), ' ', '_'), '[^A-Za-z0-9._-]', '', 'g'), 100), ''), 'upload') AS name FROM documents")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_file_name(F.col("text")).alias("name"))


@query("SELECT doc_id, 'local://scans/' || sha256(text) || '/label.png' AS reference FROM documents")
def sha256_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import stored_name

    return table(spark, sf_dir, "documents").select("doc_id", stored_name(F.col("text").cast("binary"), F.lit("label.png"), "scans").alias("reference"))


# --- products


@query("SELECT scan_id, arg_min(reference_product_id, catalogue_pos) AS reference_product_id FROM label_scans JOIN products USING (barcode) WHERE barcode <> '' GROUP BY scan_id", "label_scans", "products")
def match_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_barcode(view(spark, sf_dir, "label_scans"), view(spark, sf_dir, "products"))


@query("SELECT scan_id, min(brand) AS brand FROM label_scans JOIN (SELECT DISTINCT brand FROM products) b ON contains(lower(text), lower(b.brand)) GROUP BY scan_id", "label_scans", "products")
def brand_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.known_brand(view(spark, sf_dir, "label_scans"), view(spark, sf_dir, "products"))


_BRAND = "G AS (SELECT scan_id, any_value(text) AS text, min(brand) AS brand FROM label_scans JOIN (SELECT DISTINCT brand FROM products) b ON contains(lower(text), lower(b.brand)) GROUP BY scan_id)"
_SCORED = "S AS (SELECT scan_id, reference_product_id, catalogue_pos, CASE WHEN contains(lower(text), lower(product_name)) THEN 0.85::double ELSE 0.6::double END AS score FROM G JOIN products ON lower(G.brand) = lower(products.brand))"
_BEST = "T AS (SELECT scan_id, reference_product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, catalogue_pos) AS r FROM S) WHERE r = 1)"


def guessed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scans, products = view(spark, sf_dir, "label_scans"), view(spark, sf_dir, "products")
    return stored(match.with_brand(scans.select("scan_id", "text", "barcode"), products), "branded"), products


@query("SELECT * FROM T", "label_scans", "products", _BRAND, _SCORED, _BEST)
def match_brand_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, products = guessed(spark, sf_dir)
    return match.by_brand(scans.where("brand is not null"), products)


@query()
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, products = view(spark, sf_dir, "label_scans"), view(spark, sf_dir, "products")
    return match.by_similarity(scans, products)


@query(
    "SELECT scan_id, coalesce(x.reference_product_id, y.reference_product_id) AS reference_product_id, CASE WHEN x.scan_id IS NOT NULL THEN 'barcode' WHEN y.scan_id IS NOT NULL THEN 'fuzzy' END AS match_method, CASE WHEN x.scan_id IS NOT NULL THEN 1.0::double WHEN y.scan_id IS NOT NULL THEN y.score ELSE 0.0::double END AS match_score FROM label_scans LEFT JOIN E x USING (scan_id) LEFT JOIN (SELECT * FROM T WHERE score >= 0.72) y USING (scan_id)",
    "label_scans", "products", _BRAND, _SCORED, _BEST, "E AS (SELECT scan_id, arg_min(reference_product_id, catalogue_pos) AS reference_product_id FROM label_scans JOIN products USING (barcode) WHERE barcode <> '' GROUP BY scan_id)",
)
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode, then brand and name, without the similarity of texts."""
    scans, products = guessed(spark, sf_dir)
    return match.matched(scans, products, fuzzy=False).select("scan_id", "reference_product_id", "match_method", "match_score")


@query()
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, products = guessed(spark, sf_dir)
    return match.matched(scans, products).select("scan_id", "reference_product_id", "match_method", "match_score")


# --- comparisons


def compared(df: DataFrame, entry, *keys: str) -> DataFrame:
    return df.select(*keys, entry.alias("e")).select(*keys, "e.live", "e.reference", F.col("e.match").alias("matches"), "e.status")


_LADDER = "CASE WHEN b IS NULL THEN 'NOT_AVAILABLE' WHEN a IS NULL THEN 'REVIEW_REQUIRED' WHEN {same} THEN 'MATCH' ELSE 'MISMATCH' END AS status, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce({same}, false) END AS matches"


@query(f"SELECT k, {_LADDER.format(same='abs(a - b) < 0.01')} FROM (SELECT catalogue_pos AS k, CASE WHEN catalogue_pos % 4 = 0 THEN NULL ELSE mrp + CASE WHEN catalogue_pos % 3 = 0 THEN 0.005 WHEN catalogue_pos % 3 = 1 THEN 0.5 ELSE 0 END END AS a, mrp AS b FROM products)", "products")
def compare_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("catalogue_pos")
    live = F.when(k % 4 != 0, F.col("mrp") + F.when(k % 3 == 0, 0.005).when(k % 3 == 1, 0.5).otherwise(0))
    return compared(view(spark, sf_dir, "products").withColumn("k", k), compare.compare_number(live, F.col("mrp")), "k").select("k", "status", "matches")


@query(f"SELECT k, a AS live, b AS reference, {_LADDER.format(same='lower(trim(a)) = lower(trim(b))')} FROM (SELECT catalogue_pos AS k, CASE catalogue_pos % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || upper(manufacturer) ELSE product_name END AS a, manufacturer AS b FROM products)", "products")
def compare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("catalogue_pos")
    live = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit(" "), F.upper("manufacturer"))).otherwise(F.col("product_name"))
    return compared(view(spark, sf_dir, "products").withColumn("k", k), compare.compare_text(live, F.col("manufacturer")), "k")


@query(
    f"SELECT k, {_LADDER.format(same='a = b')} FROM (SELECT catalogue_pos AS k, CASE catalogue_pos % 4 WHEN 0 THEN NULL WHEN 1 THEN '2024-03-05' WHEN 2 THEN '2024-03-06' ELSE 'unclear' END AS a, CASE WHEN pkd = '05/03/24' THEN '2024-03-05' ELSE '2024-03-06' END AS b FROM products)",
    "products",
)
def compare_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("catalogue_pos")
    live = F.when(k % 4 == 1, "5.3.2024").when(k % 4 == 2, "06/03/24").when(k % 4 == 3, "unclear")
    return compared(view(spark, sf_dir, "products").withColumn("k", k), compare.compare_date(live, F.col("pkd")), "k").select("k", "status", "matches")


@query(
    f"""SELECT k, CASE WHEN b IS NULL OR known IS NULL THEN 'raw' WHEN a IS NOT NULL THEN '200 ' || CASE u WHEN 1 THEN 'g' ELSE 'kg' END END AS live, CASE WHEN a IS NULL OR known IS NULL THEN b ELSE known END AS reference,
    CASE WHEN known IS NULL THEN 'NOT_AVAILABLE' WHEN a IS NULL THEN 'REVIEW_REQUIRED' WHEN v = w AND u = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status, CASE WHEN a IS NOT NULL AND known IS NOT NULL THEN v = w AND u = 1 END AS matches
    FROM (SELECT catalogue_pos AS k, CASE catalogue_pos % 3 WHEN 0 THEN NULL ELSE 1 END AS a, CASE WHEN catalogue_pos % 7 = 0 THEN 'a few' ELSE net_weight END AS b, CASE WHEN catalogue_pos % 7 = 0 THEN NULL ELSE net_weight END AS known, 200.0 AS v, try_cast(split_part(net_weight, ' ', 1) AS double) AS w, catalogue_pos % 3 AS u FROM products)""",
    "products",
)
def compare_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("catalogue_pos")
    value, unit = F.when(k % 3 != 0, F.lit(200.0)), F.when(k % 3 == 1, "g").when(k % 3 == 2, "kg")
    return compared(view(spark, sf_dir, "products").withColumn("k", k), compare.compare_quantity(value, unit, F.lit("raw"), F.when(k % 7 == 0, "a few").otherwise(F.col("net_weight"))), "k")


@query("SELECT catalogue_pos, CASE WHEN mrp IS NOT NULL THEN cast(mrp AS varchar) WHEN catalogue_pos % 6 = 0 THEN '1,2' || cast(catalogue_pos % 10 AS varchar) || '0.50' END AS mrp_text FROM products", "products")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = compare.json_fields(F.col("reference_fields_json"))
    return view(spark, sf_dir, "products").select("catalogue_pos", compare.reference_value(F.col("mrp").cast("string"), members, "mrp").alias("mrp_text"))


@query("SELECT a.s_suppkey AS k, regexp_replace(regexp_replace(lower(n), '\\bprivate\\b', 'pvt', 'g'), '\\blimited\\b', 'ltd', 'g') AS low, trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '\\bprivate\\b', 'pvt', 'g'), '\\blimited\\b', 'ltd', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normal FROM (SELECT s_suppkey, s_name || ', Foods (Private) Limited' AS n FROM supplier) a")
def company_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("s_name"), F.lit(", Foods (Private) Limited"))
    low = F.regexp_replace(F.regexp_replace(F.lower(name), r"\bprivate\b", "pvt"), r"\blimited\b", "ltd")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), low.alias("low"), text.normal_company(name).alias("normal"))


# --- rules


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence view with its maps."""
    e = view(spark, sf_dir, "evidence")
    here = {"mrp": "p_mrp", "net_quantity": "p_net", "manufacturer_address": "p_addr", "manufacturing_date": "p_mfg", "use_by": "p_use", "best_before": "p_best", "consumer_care_contact": "p_care"}
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit("1").alias("live"), F.lit("2").alias("reference"), (F.col(c) == "MATCH").alias("match"), F.col(c).alias("status")))
    maker = F.when(F.col("known_maker").isNotNull(), F.struct(F.col("address").alias("live"), F.col("known_maker").alias("reference"), F.lit(False).alias("match"), F.lit("MISMATCH").alias("status")))
    compared_map = F.map_filter(F.create_map(F.lit("mrp"), entry("c_mrp"), F.lit("net_quantity"), entry("c_net"), F.lit("manufacturer"), maker), lambda k, v: v.isNotNull())
    presence = F.create_map(*(x for k, c in here.items() for x in (F.lit(k), F.col(c))))
    return e.withColumns({"presence": presence, "comparisons": compared_map, "address_value": F.col("address"), "address_raw": F.col("address")})


_ACTIVE = "(SELECT * FROM rules WHERE is_active AND (effective_from IS NULL OR effective_from <= DATE '2024-06-30') AND (effective_to IS NULL OR effective_to >= DATE '2024-06-30'))"
_HERE = "CASE field_name WHEN 'mrp' THEN p_mrp WHEN 'net_quantity' THEN p_net WHEN 'manufacturer_address' THEN p_addr WHEN 'consumer_care_contact' THEN p_care ELSE false END"
_NOISY = "(field_name = 'manufacturer_address' AND regexp_matches(lower(address), 'queries|contact'))"
_COUNT = "(p_mrp::int + p_net::int + (p_addr AND NOT regexp_matches(lower(address), 'queries|contact'))::int + p_mfg::int + p_use::int + p_best::int + p_care::int)"
_ENTRY = "CASE expected_value WHEN 'mrp' THEN c_mrp WHEN 'net_quantity' THEN c_net END"
_CHECKS = f"""K AS (SELECT scan_id, rule_pos, rule_code, field_name, severity, operator, ocr_status, CASE
  WHEN ocr_status <> 'success' AND operator <> 'tampering_score_below' THEN 'NOT_APPLICABLE'
  WHEN operator = 'field_present' THEN CASE WHEN NOT ({_HERE}) THEN 'FAIL' WHEN {_NOISY} THEN 'REVIEW_REQUIRED' ELSE 'PASS' END
  WHEN operator = 'any_field_present' THEN CASE WHEN p_mfg OR p_use OR p_best THEN 'PASS' ELSE 'FAIL' END
  WHEN operator = 'min_declarations' THEN CASE WHEN {_COUNT} >= cast(expected_value AS int) THEN 'PASS' ELSE 'FAIL' END
  WHEN operator = 'tampering_score_below' THEN CASE WHEN tampering_status <> 'success' THEN 'NOT_APPLICABLE' WHEN tampering_score < cast(expected_value AS double) THEN 'PASS' ELSE 'REVIEW_REQUIRED' END
  WHEN operator = 'reference_field_match' THEN CASE WHEN NOT reference_found OR expected_value IN ('use_by', 'best_before', 'packing_date', 'manufacturing_date') OR coalesce({_ENTRY}, 'NOT_AVAILABLE') = 'NOT_AVAILABLE' THEN 'NOT_APPLICABLE' WHEN {_ENTRY} = 'MATCH' THEN 'PASS' ELSE 'REVIEW_REQUIRED' END
  ELSE 'NOT_APPLICABLE' END AS status FROM evidence CROSS JOIN {_ACTIVE} r)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(gathered(spark, sf_dir), rules.active(view(spark, sf_dir, "rules"), F.lit(AS_OF)))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.folded(judged(spark, sf_dir))


@query("SELECT scan_id, rule_code, status, severity FROM K", "evidence", "rules", _CHECKS)
def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("scan_id", F.inline("tm_checks")).select("scan_id", "rule_code", "status", "severity")


_FOLD = """F AS (SELECT scan_id, any_value(ocr_status) AS ocr, bool_or(status = 'FAIL' AND severity = 'high') AS hi, bool_or(status IN ('FAIL', 'REVIEW_REQUIRED')) AS op,
  max(CASE WHEN status IN ('FAIL', 'REVIEW_REQUIRED') THEN CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END ELSE 0 END) AS rk,
  coalesce(string_agg(field_name, ', ' ORDER BY rule_pos) FILTER ((operator = 'field_present' AND status IN ('FAIL', 'REVIEW_REQUIRED')) OR (operator = 'any_field_present' AND status = 'FAIL')), '') AS missing,
  bool_or(rule_code = 'LM-006' AND status = 'FAIL') AS zero FROM K GROUP BY scan_id)"""
_STATUS = "CASE WHEN ocr <> 'success' THEN 'REVIEW_REQUIRED' WHEN hi THEN 'NON_COMPLIANT' WHEN op THEN 'REVIEW_REQUIRED' ELSE 'PASS' END"
_RISK = "CASE WHEN ocr <> 'success' THEN 'MEDIUM' ELSE CASE rk WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'NONE' END END"


@query(f"SELECT scan_id, {_STATUS} AS overall_status, {_RISK} AS risk_level, missing AS missing_fields FROM F", "evidence", "rules", _CHECKS, _FOLD)
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("scan_id", "overall_status", "risk_level", F.array_join("missing_fields", ", ").alias("missing_fields"))


@query(f"SELECT {_STATUS} AS overall_status, {_RISK} AS risk_level, count(*) AS scans FROM F GROUP BY 1, 2", "evidence", "rules", _CHECKS, _FOLD)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).groupBy("overall_status", "risk_level").agg(F.count("*").alias("scans"))


_MAKER = "CASE WHEN known_maker IS NOT NULL THEN CASE WHEN contains(address, 'Acme') AND contains(known_maker, 'ACME') THEN 'MATCH' ELSE 'MISMATCH' END END"


@query(
    f"""SELECT scan_id, array_to_string(list_filter([CASE WHEN c_mrp = 'MATCH' THEN 'mrp=true:MATCH' END, CASE WHEN c_net = 'MATCH' THEN 'net_quantity=true:MATCH' END, CASE WHEN {_MAKER} = 'MATCH' THEN 'manufacturer=true:MATCH' END], lambda x: x IS NOT NULL), ',') AS matched,
    array_to_string(list_filter([CASE WHEN c_mrp = 'MISMATCH' THEN 'mrp=false:MISMATCH' END, CASE WHEN c_net = 'MISMATCH' THEN 'net_quantity=false:MISMATCH' END, CASE WHEN {_MAKER} = 'MISMATCH' THEN 'manufacturer=false:MISMATCH' END], lambda x: x IS NOT NULL), ',') AS mismatched FROM evidence""",
    "evidence",
)
def matched_mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the order of comparison; a maker that matches after normalising is shown as a match."""
    entries = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]["match"].cast("string"), F.lit(":"), e["value"]["status"])), ",")
    return folded(spark, sf_dir).select("scan_id", entries("matched_fields").alias("matched"), entries("mismatched_fields").alias("mismatched"))


# The texts of verdicts, from the service whose results these are: fixed values, kept apart from those in operators.rules.
_UNREAD = "Declaration checks could not be run because OCR was unavailable - rescan or review manually."
_NEAR_ZERO = "Near-zero declarations found - likely a completely unlabeled or non-compliant product."
_VERDICT = f"CASE WHEN ocr <> 'success' THEN '{_UNREAD}' WHEN zero THEN '{_NEAR_ZERO}' END"


@query(f"SELECT scan_id, coalesce({_VERDICT}, '') AS warnings FROM F", "evidence", "rules", _CHECKS, _FOLD)
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("scan_id", F.array_join("warnings", "|").alias("warnings"))


_GAPS = "CASE WHEN missing <> '' THEN cast(len(string_split(missing, ', ')) AS varchar) || ' mandatory declaration(s) missing: ' || missing || '.' END"
_UNLIKE = f"list_filter([CASE WHEN c_mrp = 'MISMATCH' THEN 'mrp' END, CASE WHEN c_net = 'MISMATCH' THEN 'net_quantity' END, CASE WHEN {_MAKER} = 'MISMATCH' THEN 'manufacturer' END], lambda x: x IS NOT NULL)"


@query(
    f"""SELECT scan_id, CASE WHEN ocr <> 'success' THEN 'Label text could not be read (OCR unavailable) - declaration checks were skipped for this scan.' ELSE
    concat_ws(' ', {_GAPS}, CASE WHEN len(u) > 0 THEN cast(len(u) AS varchar) || ' field(s) do not match the reference product: ' || array_to_string(u, ', ') || '.' END,
    CASE WHEN missing = '' AND len(u) = 0 THEN 'All applicable declarations were found and passed the configured consistency checks.' END, 'Overall risk level: ' || {_RISK} || '.') END AS explanation FROM F JOIN (SELECT scan_id, {_UNLIKE} AS u FROM evidence) USING (scan_id)""",
    "evidence", "rules", _CHECKS, _FOLD,
)
def explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("scan_id", "explanation")


@query("SELECT scan_id, string_agg(rule_code || '=' || status || ':' || severity, ',' ORDER BY rule_pos) AS results FROM K GROUP BY scan_id", "evidence", "rules", _CHECKS)
def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("rule_results", lambda x: F.concat(x["rule_code"], F.lit("="), x["status"], F.lit(":"), x["severity"]))
    return folded(spark, sf_dir).select("scan_id", F.array_join(shown, ",").alias("results"))


@query("SELECT scan_id, string_agg(rule_code, ',' ORDER BY rule_pos) AS applicable FROM K WHERE status <> 'NOT_APPLICABLE' GROUP BY scan_id", "evidence", "rules", _CHECKS)
def applicable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.transform(rules.applicable(F.col("rule_results")), lambda x: x["rule_code"])
    return folded(spark, sf_dir).select("scan_id", F.array_join(kept, ",").alias("applicable")).where("applicable <> ''")


@query(
    f"""SELECT scan_id, array_to_string(list_filter([{_VERDICT}, CASE WHEN ocr <> 'success' THEN 'OCR did not complete successfully; results may be incomplete.' END,
    CASE WHEN scan_id % 4 <> 0 THEN 'No barcode detected on this image.' END, CASE WHEN tampering_status <> 'success' THEN 'Tampering evidence unavailable for this scan.' END,
    CASE WHEN NOT reference_found THEN 'No matching reference product found; showing extraction and available checks only.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM F JOIN evidence USING (scan_id)""",
    "evidence", "rules", _CHECKS, _FOLD,
)
def response_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).withColumn("barcode", F.when(F.col("scan_id") % 4 == 0, F.lit("8901")).otherwise(""))
    return rows.select("scan_id", F.array_join(pipeline.response_warnings(), "|").alias("warnings"))


@query(f"SELECT scan_id, {_COUNT} AS declarations FROM evidence", "evidence")
def declaration_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = gathered(spark, sf_dir)
    noisy = text.contact_noise(F.col("address_value"), F.col("address_raw"))
    return seen.select("scan_id", rules.declaration_count(F.col("presence"), noisy).alias("declarations"))


_SPOKEN = """Q AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN ' pass' WHEN 1 THEN 'Compliant' WHEN 2 THEN 'non_compliant' WHEN 3 THEN 'FAILED ' WHEN 4 THEN o_orderstatus WHEN 5 THEN NULL WHEN 6 THEN 'Processing' ELSE 'review_required' END AS s,
  CASE o_orderkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'low ' WHEN 2 THEN 'HIGH' WHEN 3 THEN NULL ELSE 'Medium' END AS r FROM orders)"""


@query("SELECT k, CASE WHEN upper(trim(s)) IN ('PASS', 'COMPLIANT') THEN 'compliant' WHEN upper(trim(s)) IN ('NON_COMPLIANT', 'REVIEW_REQUIRED', 'PROCESSING', 'FAILED') THEN lower(trim(s)) ELSE 'review_required' END AS status, CASE WHEN upper(trim(r)) IN ('LOW', 'MEDIUM', 'HIGH') THEN lower(trim(r)) END AS risk FROM Q", _SPOKEN)
def status_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.get(F.array(*(F.lit(v) for v in values)), (k % n).cast("int"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), pick(8, " pass", "Compliant", "non_compliant", "FAILED ", F.col("o_orderstatus"), none, "Processing", "review_required").alias("s"), pick(5, "NONE", "low ", "HIGH", none, "Medium").alias("r"))
    return rows.select("k", rules.stored_status(F.col("s")).alias("status"), rules.stored_risk(F.col("r")).alias("risk"))


# --- recognised words, barcodes, images

_USABLE = "W AS (SELECT * FROM ocr_words WHERE trim(text) <> '' AND conf >= 0 AND (conf / 100 >= 0.15 OR regexp_matches(text, '[A-Za-z0-9]')))"
_OCR_LINES = 'N AS (SELECT scan_id, pass_no, block_num, par_num, line_num, string_agg(trim(text), \' \' ORDER BY "left", pos) AS text, round_even(avg(conf / 100), 4) AS confidence, min("left") AS l, min(top) AS t, min(pos) AS p FROM W GROUP BY ALL)'.replace("GROUP BY ALL", "GROUP BY scan_id, pass_no, block_num, par_num, line_num")


@query("SELECT scan_id, pass_no, block_num, par_num, line_num, text, confidence FROM N", "ocr_words", _USABLE, _OCR_LINES)
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.text_lines(view(spark, sf_dir, "ocr_words")).select("scan_id", "pass_no", "block_num", "par_num", "line_num", "text", "confidence")


_OCR_TEXTS = "X AS (SELECT scan_id, pass_no, string_agg(text, chr(10) ORDER BY t, l, p) AS text, round_even(sum(least(greatest(confidence, 0), 1) * least(length(text), 80)) + 0.08 * sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) + 1.5 * count(*) FILTER (confidence >= 0.6), 9) AS quality FROM N GROUP BY scan_id, pass_no)"


@query("SELECT scan_id, pass_no, text FROM X", "ocr_words", _USABLE, _OCR_LINES, _OCR_TEXTS)
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.scan_texts(ocr.text_lines(view(spark, sf_dir, "ocr_words"))).select("scan_id", "pass_no", "text")


_PASSES = "P AS (SELECT DISTINCT scan_id, pass_no FROM ocr_words)"


def every_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = view(spark, sf_dir, "ocr_words")
    return ocr.scan_texts(ocr.text_lines(words), ocr.all_passes(words))


@query("SELECT scan_id, pass_no FROM P LEFT JOIN (SELECT scan_id, pass_no, round_even(avg(confidence), 4) AS confidence FROM N GROUP BY scan_id, pass_no) USING (scan_id, pass_no) WHERE coalesce(confidence, 0) < 0.45", "ocr_words", _PASSES, _USABLE, _OCR_LINES)
def ocr_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.needs_retry(every_pass(spark, sf_dir)).select("scan_id", "pass_no")


@query("SELECT scan_id, pass_no, round_even(quality, 6) AS quality FROM (SELECT scan_id, pass_no, coalesce(quality, 0) AS quality, row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(quality, 0) DESC, pass_no) AS r FROM P LEFT JOIN X USING (scan_id, pass_no)) WHERE r = 1", "ocr_words", _PASSES, _USABLE, _OCR_LINES, _OCR_TEXTS)
def ocr_pass_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.best_pass(every_pass(spark, sf_dir)).select("scan_id", "pass_no", F.bround("quality", 6).alias("quality"))


@query("SELECT scan_id, arg_min(value, (-n, f)) AS value, max(n) AS votes FROM (SELECT scan_id, text AS value, count(*) AS n, min(pos) AS f FROM ocr_words GROUP BY 1, 2) GROUP BY scan_id HAVING max(n) >= 2", "ocr_words")
def vote_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.majority(view(spark, sf_dir, "ocr_words").withColumnRenamed("text", "value"), ["scan_id"], 2)


_VALID = "V AS (SELECT scan_id, pos, trim(value) AS value, upper(coalesce(type, '')) AS type, greatest(w * h, 0) AS area FROM barcode_candidates WHERE trim(value) <> '' AND length(trim(value)) <= 80 AND upper(coalesce(type, '')) IN ('', 'EAN13', 'EAN8', 'UPCA', 'UPCE', 'CODE128', 'CODE39', 'QRCODE', 'ITF', 'I25') AND (upper(coalesce(type, '')) NOT IN ('EAN13', 'EAN8', 'UPCA', 'UPCE', 'ITF', 'I25') OR regexp_full_match(trim(value), '[0-9]+')))"


@query("SELECT scan_id, pos, value, type, area FROM V", "barcode_candidates", _VALID)
def barcode_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcode.valid(view(spark, sf_dir, "barcode_candidates")).select("scan_id", "pos", "value", "type", "area")


@query("SELECT scan_id, value, type, area, pos FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY type <> '' DESC, (type IN ('EAN13', 'EAN8', 'UPCA', 'UPCE', 'ITF', 'I25') AND regexp_full_match(value, '[0-9]+')) DESC, (length(value) BETWEEN 7 AND 20) DESC, area DESC, pos) AS r FROM V) WHERE r = 1", "barcode_candidates", _VALID)
def barcode_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcode.best(view(spark, sf_dir, "barcode_candidates"))


def _check(body: str) -> str:
    return f"(10 - ({' + '.join(f'{3 if i % 2 == 0 else 1} * substr({body}, {i}, 1)::int' for i in range(1, 13))}) % 10) % 10"


@query(f"SELECT k, regexp_full_match(c, '[0-9]{{13}}') AND {_check('c')} = substr(c, 13, 1)::int AS valid FROM (SELECT p_partkey AS k, '890' || lpad((p_partkey * 7919)::varchar, 10, '0') AS c FROM part)")
def ean_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("890"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 10, "0"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), numbers.is_article_number(code).alias("valid"))


@query(
    f"""SELECT k, coalesce(string_agg(c, ',' ORDER BY c), '') AS codes FROM (SELECT DISTINCT k, CASE WHEN {_check('c')} = substr(c, 13, 1)::int THEN c END AS c FROM (
    SELECT k, substr(d, i::int, 13) AS c FROM D, range(1, 5) r(i) UNION ALL SELECT k, '8' || substr(d, i::int, 12) FROM D, range(1, 6) r(i) UNION ALL SELECT k, substr(d, i::int, 12) || '8' FROM D, range(1, 6) r(i))) GROUP BY k""",
    "D AS (SELECT p_partkey AS k, lpad(((p_partkey * 104729 + 890171912387) * 37)::varchar, 16, '3') AS d FROM part)",
)
def ean_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.lpad(((F.col("p_partkey") * 104729 + 890171912387) * 37).cast("string"), 16, "3")
    codes = numbers.article_numbers(F.array(F.concat(F.lit("no. "), run), F.lit(" 8 "), F.lit("")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(codes, ",").alias("codes"))


_SHAPED = "G AS (SELECT *, round_even(gradient_ratio + CASE WHEN y > 0.45 * img_h THEN 2.0 ELSE 0.0 END + least(w * h / 20000.0, 2.0) + least(w / greatest(h, 1)::double / 4, 2.0), 6) AS score FROM regions WHERE w >= 60 AND h >= 30 AND w * h >= 1500 AND w / greatest(h, 1)::double >= 1.25 AND NOT (w > 0.9 * img_w AND h > 0.5 * img_h) AND gradient_ratio >= 2.0)"


@query("SELECT scan_id, pos, r AS region_rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, pos)::int AS r FROM G) WHERE r <= 4", "regions", _SHAPED)
def region_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.barcode_regions(view(spark, sf_dir, "regions")).select("scan_id", "pos", "region_rank")


_NOISE = "Z AS (SELECT scan_id, count(*) AS n_tiles, CASE WHEN count(*) >= 12 THEN least(greatest((stddev_pop(residual_median) / (avg(residual_median) + 1e-6) - 0.6) / 1.4, 0), 1) ELSE 0 END AS s FROM tiles WHERE edge_density <= 0.08 AND residual_median >= 0.3 GROUP BY scan_id)"


@query("SELECT scan_id, n_tiles, round(s, 6) AS noise_signal FROM Z", "tiles", _NOISE)
def noise_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.noise_spread(view(spark, sf_dir, "tiles")).withColumn("noise_signal", F.round("noise_signal", 6))


@query("SELECT coalesce(b.scan_id, Z.scan_id) AS scan_id, coalesce(n, 0) AS n_boxes, round_even(0.5 * least(coalesce(n, 0) / 3.0, 1.0) + 0.5 * coalesce(s, 0), 3)::double AS tampering_score FROM (SELECT scan_id, count(*) AS n FROM contours WHERE w * h / image_area::double BETWEEN 0.004 AND 0.12 AND vertices = 4 AND rectangularity > 0.85 GROUP BY scan_id) b FULL JOIN Z ON b.scan_id = Z.scan_id", "contours", "tiles", _NOISE)
def tamper_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.tampering(view(spark, sf_dir, "contours"), view(spark, sf_dir, "tiles")).select("scan_id", "n_boxes", "tampering_score")


@query("SELECT scan_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS r FROM contours WHERE w * h / image_area::double BETWEEN 0.004 AND 0.12 AND vertices = 4 AND rectangularity > 0.85) WHERE r <= 20", "contours")
def sticker_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.shown_boxes(view(spark, sf_dir, "contours")).select("scan_id", "pos")


_SIDES = "S AS (SELECT p_partkey AS scan_id, (p_partkey * 37 % 3000 + 8)::int AS width, (p_partkey * 53 % 2500 + 8)::int AS height FROM part)"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("scan_id"), (k * 37 % 3000 + 8).cast("int").alias("width"), (k * 53 % 2500 + 8).cast("int").alias("height"))


@query("SELECT scan_id, round(CASE WHEN greatest(width, height) > 1800 THEN 1800.0::double / greatest(width, height) WHEN greatest(width, height) < 800 THEN 800.0::double / greatest(width, height) ELSE 1.0 END, 6)::double AS factor FROM S", _SIDES)
def resize_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("scan_id", F.round(vision.resize_factor(F.col("height"), F.col("width")), 6).alias("factor"))


@query(
    """SELECT scan_id, 'full' AS region, 0 AS x, 0 AS y, width AS w, height AS h FROM S UNION ALL SELECT scan_id, 'lower_60', 0, floor(height * 0.40)::int, width, height - floor(height * 0.40)::int FROM S WHERE width >= 20 AND height >= 20
    UNION ALL SELECT scan_id, 'lower_40', 0, floor(height * 0.60)::int, width, height - floor(height * 0.60)::int FROM S WHERE width >= 20 AND height >= 20
    UNION ALL SELECT scan_id, 'lower_left', floor(width * 0.05)::int, floor(height * 0.45)::int, floor(width * 0.65)::int - floor(width * 0.05)::int, height - floor(height * 0.45)::int FROM S WHERE width >= 20 AND height >= 20""",
    _SIDES,
)
def decoder_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.decoder_regions(sides(spark, sf_dir))


@query("SELECT k, regexp_full_match(t, '([0-9]{1,2} *[/-] *[0-9]{1,2}( *[/-] *[0-9]{2,4})?|[0-9]{1,2} *[.] *[0-9]{1,2} *[.] *[0-9]{2,4})') AS looks FROM (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '5/3/24' WHEN 1 THEN '05 - 03' WHEN 2 THEN '5.3' WHEN 3 THEN '5.3.2024' WHEN 4 THEN 'May 2024' ELSE '123/4/24' END AS t FROM part)")
def date_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text_ = F.element_at(F.array(*map(F.lit, ("5/3/24", "05 - 03", "5.3", "5.3.2024", "May 2024", "123/4/24"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("k"), dates.looks_like_date(text_).alias("looks"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE round(p_partkey + 1000, 2)::double END AS price FROM part")
def reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    shown = F.call_function("format_number", k + 1000, F.lit("#,##0.00"))
    forms = F.when(k % 5 == 0, F.concat(F.lit("₹"), shown)).when(k % 5 == 1, F.concat(F.lit("Rs. "), shown, F.lit(" (incl.)"))).when(k % 5 == 2, shown).when(k % 5 == 3, (k + 1000).cast("string")).otherwise("on request")
    return table(spark, sf_dir, "part").select(k.alias("k"), numbers.reference_price(forms).alias("price"))


@query("SELECT k, printf('%g', v) AS shown FROM (SELECT p_partkey AS k, p_partkey * 12.5 / (1 + p_partkey % 7) AS v FROM part)")
def number_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), numbers.plain_number(k * 12.5 / (1 + k % 7)).alias("shown"))


@query("SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE 'code ' || k END AS payload FROM (SELECT p_partkey AS k FROM part)")
def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.lit(b"  \xff ")).otherwise(F.concat(F.lit(b" \xfecode "), k.cast("string").cast("binary"), F.lit(b"\xc3")))
    return table(spark, sf_dir, "part").select(k.alias("k"), text.payload_text(raw).alias("payload"))


@query("SELECT mode, scan_id, status, score FROM (SELECT 'heuristic' AS mode, coalesce(b.scan_id, Z.scan_id) AS scan_id, 'success' AS status, round_even(0.5 * least(coalesce(n, 0) / 3.0, 1.0) + 0.5 * coalesce(s, 0), 3)::double AS score FROM (SELECT scan_id, count(*) AS n FROM contours WHERE w * h / image_area::double BETWEEN 0.004 AND 0.12 AND vertices = 4 AND rectangularity > 0.85 GROUP BY scan_id) b FULL JOIN Z ON b.scan_id = Z.scan_id) UNION ALL SELECT m, scan_id, 'unavailable', NULL FROM (SELECT unnest(['disabled', 'remote']) AS m), (SELECT scan_id FROM contours UNION SELECT scan_id FROM tiles)", "contours", "tiles", _NOISE)
def tampering_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a remote scorer the remote mode is unavailable, as the disabled one is."""
    seen = {m: vision.tampering_evidence(view(spark, sf_dir, "contours"), view(spark, sf_dir, "tiles"), m) for m in ("heuristic", "disabled", "remote")}
    rows = [d.select(F.lit(m).alias("mode"), "scan_id", F.col("tampering_status").alias("status"), F.col("tampering_score").alias("score")) for m, d in seen.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- tables


@query("SELECT o_orderkey AS scan_id, o_orderstatus AS status, count(l_linenumber) AS details FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def header_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("status"))
    details = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), "l_linenumber")
    joined = sinks.with_details(header, details=details)
    return joined.select("scan_id", "status", F.size("details").cast("long").alias("details"))


@query("SELECT o_orderkey AS scan_id, o_orderstatus AS status, count(l_linenumber) AS details, coalesce(sum(l_quantity), 0)::double AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def header_details_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with their details from tables in buckets of the scan: neither grouping nor join moves a row."""
    header = layout.bucketed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("status")), "header")
    details = layout.bucketed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_quantity").cast("double").alias("quantity")), "details")
    joined = sinks.with_details(header, details=details)
    total = F.aggregate("details", F.lit(0.0), lambda a, x: a + x["quantity"])
    return joined.select("scan_id", "status", F.size("details").cast("long").alias("details"), total.alias("quantity"))


@query("SELECT cast(event_id AS varchar) AS scan_id, ts AS created_at, event_type AS compliance_status FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def history_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest scans from a table in partitions of the day, of which only the newest are read."""
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("detected_product_name"), F.lit("").alias("reference_product_id"), F.col("event_type").alias("status"))
    return sinks.history(layout.latest(spark, layout.by_day(records, "records"), 200), 200).select("scan_id", "created_at", "compliance_status")


_OLD = "A AS (SELECT reference_product_id, brand, mrp FROM products), B AS (SELECT CASE WHEN catalogue_pos % 2 = 0 THEN '' ELSE 'new ' END || reference_product_id AS reference_product_id, 'new ' || brand AS brand, NULL::double AS mrp FROM products)"


def edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The products, and as many edits of which one half has keys of products."""
    p = view(spark, sf_dir, "products").select("catalogue_pos", "reference_product_id", "brand", "mrp")
    key = F.concat(F.when(F.col("catalogue_pos") % 2 == 0, "").otherwise("new "), "reference_product_id")
    return p.drop("catalogue_pos"), p.select(key.alias("reference_product_id"), F.concat(F.lit("new "), "brand").alias("brand"), F.lit(None).cast("double").alias("mrp"))


@query("SELECT reference_product_id, coalesce(B.brand, A.brand) AS brand, coalesce(B.mrp, A.mrp) AS mrp FROM A FULL JOIN B USING (reference_product_id)", "products", _OLD)
def upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.upsert(*edited(spark, sf_dir), "reference_product_id")


@query("SELECT reference_product_id, coalesce(B.brand, A.brand) AS brand, coalesce(B.mrp, A.mrp) AS mrp FROM A FULL JOIN B USING (reference_product_id)", "products", _OLD)
def seed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = edited(spark, sf_dir)
    return sinks.seeded(old, new.withColumn("extra", F.lit(1)).unionByName(new.limit(1).select(F.lit(None).cast("string").alias("reference_product_id"), "brand", "mrp", F.lit(1).alias("extra"))), "reference_product_id")


@query("SELECT reference_product_id, coalesce(B.brand, A.brand) AS brand, coalesce(B.mrp, A.mrp) AS mrp FROM A FULL JOIN B USING (reference_product_id)", "products", _OLD)
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edits into a stored table of which only the touched buckets are written again."""
    old, new = edited(spark, sf_dir)
    folder = fresh(spark, "catalogue")
    buckets.upsert(old, folder, "reference_product_id")
    buckets.upsert(new, folder, "reference_product_id")
    return buckets.read(spark, folder)


@query("SELECT * FROM A UNION ALL SELECT * FROM B WHERE reference_product_id NOT IN (SELECT reference_product_id FROM A)", "products", _OLD)
def insert_missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.insert_missing(*edited(spark, sf_dir), "reference_product_id")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 100 AS scan_id FROM orders")
def identity_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.numbered(table(spark, sf_dir, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 100).select("o_orderkey", "o_custkey", "o_orderpriority", "scan_id")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS scan_id, o_orderkey, o_orderpriority AS batch FROM orders")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in five batches by priority, each batch twice: ids run on, and a repeated batch adds nothing."""
    folder = fresh(spark, "ledger")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    for (name,) in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect():  # five
        rows = orders.where(F.col("o_orderpriority") == name).withColumnRenamed("o_orderpriority", "batch")
        for _ in range(2):
            sinks.append_batch({"orders": rows}, folder, name, [F.asc("o_orderkey")])
    return sinks.committed(spark, folder, "orders")


def results(spark: SparkSession, sf_dir: str, fuzzy: bool = True) -> DataFrame:
    return pipeline.evaluate(view(spark, sf_dir, "label_scans"), view(spark, sf_dir, "products"), view(spark, sf_dir, "rules"), fuzzy=fuzzy)


_ZOOMED = "zoomed AS (SELECT scan_id, ocr_status, barcode, tampering_status, tampering_score, CASE WHEN ocr_status = 'success' AND coalesce(zoom_text, '') <> '' AND NOT regexp_matches(text, '(?i)mfg|pkd|use by|best before') THEN text || chr(10) || zoom_text ELSE text END AS text FROM label_scans)"


def _over_zoomed(name: str) -> str:
    """The twin of another query as a subquery, over the texts with their zoomed part."""
    return ORACLE[name].replace(f"label_scans AS MATERIALIZED ({oracle_view('label_scans')})", "label_scans AS (SELECT * FROM zoomed)")


_FOUND = f"""R AS MATERIALIZED (SELECT z.*, mrp_raw, net_quantity_raw, packing_date_raw, use_by_raw, best_before_raw, maker_raw, care_raw, reference_product_id, match_method, match_score FROM zoomed z LEFT JOIN ({_over_zoomed('mrp_extract')}) USING (scan_id)
  LEFT JOIN ({_over_zoomed('net_quantity_extract')}) USING (scan_id) LEFT JOIN ({_over_zoomed('date_extract_pkd')}) USING (scan_id) LEFT JOIN ({_over_zoomed('date_extract_use_by')}) USING (scan_id)
  LEFT JOIN ({_over_zoomed('date_extract_best_before')}) USING (scan_id) LEFT JOIN ({_over_zoomed('manufacturer_phases')}) USING (scan_id) LEFT JOIN ({_over_zoomed('contact_extract')}) USING (scan_id) JOIN ({_over_zoomed('match_exact')}) USING (scan_id)),
Y AS MATERIALIZED (SELECT *, try_cast(nullif(regexp_extract(mrp_raw, '[0-9]+[.]?[0-9]*'), '') AS double) AS live_mrp, try_cast(CASE WHEN len(vs) = 0 THEN NULL WHEN t <> '' THEN t ELSE vs[-1] END AS double) AS qty, lower(CASE WHEN len(vs) = 0 THEN NULL WHEN t <> '' THEN coalesce(nullif(tu, ''), us[1]) ELSE us[-1] END) AS u FROM
  (SELECT *, regexp_extract_all(net_quantity_raw, {q(numbers.NUMBER_UNIT)}, 1) AS vs, regexp_extract_all(net_quantity_raw, {q(numbers.NUMBER_UNIT)}, 2) AS us, regexp_extract(net_quantity_raw, {q(numbers.TOTAL)}, 1) AS t, regexp_extract(net_quantity_raw, {q(numbers.TOTAL)}, 2) AS tu, string_split_regex(packing_date_raw, '[/.\\-]') AS p FROM R)),
V AS MATERIALIZED (SELECT Y.*, {_UNIT_CASE} AS unit, CASE WHEN len(p) = 3 THEN coalesce(cast({_DAY} AS varchar), packing_date_raw) ELSE packing_date_raw END AS packed, coalesce(r.mrp, CASE WHEN r.catalogue_pos % 6 = 0 THEN cast(replace(json_extract_string(r.reference_fields_json, '$.mrp'), ',', '') AS double) END) AS ref_mrp, r.net_weight AS ref_weight, r.product_name AS ref_name, r.brand AS ref_brand, r.reference_product_id IS NOT NULL AS known FROM Y LEFT JOIN products r USING (reference_product_id)),
evidence AS MATERIALIZED (SELECT scan_id, ocr_status, mrp_raw IS NOT NULL AS p_mrp, net_quantity_raw IS NOT NULL AS p_net, maker_raw IS NOT NULL AS p_addr, packing_date_raw IS NOT NULL AS p_mfg, use_by_raw IS NOT NULL AS p_use, best_before_raw IS NOT NULL AS p_best, care_raw IS NOT NULL AS p_care, coalesce(maker_raw, '') AS address,
  tampering_status, tampering_score, known AS reference_found, CASE WHEN known THEN CASE WHEN ref_mrp IS NULL THEN 'NOT_AVAILABLE' WHEN live_mrp IS NULL THEN 'REVIEW_REQUIRED' WHEN abs(live_mrp - ref_mrp) < 0.01 THEN 'MATCH' ELSE 'MISMATCH' END END AS c_mrp,
  CASE WHEN known THEN CASE WHEN ref_weight IS NULL THEN 'NOT_AVAILABLE' WHEN qty IS NULL THEN 'REVIEW_REQUIRED' WHEN abs(qty - cast(split_part(ref_weight, ' ', 1) AS double)) < 0.01 AND unit = 'g' THEN 'MATCH' ELSE 'MISMATCH' END END AS c_net FROM V)"""


@query(
    f"""SELECT scan_id, live_mrp AS mrp, qty AS net_quantity, unit AS net_quantity_unit, packed AS packing_date, match_method, match_score, {_STATUS} AS overall_status, {_RISK} AS risk_level, missing AS missing_fields FROM F JOIN V USING (scan_id)""",
    "label_scans", "products", "rules", _ZOOMED, _FOUND, _CHECKS, _FOLD,
)
def scan_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan but for the similarity of texts, which has no SQL form."""
    return results(spark, sf_dir, fuzzy=False).select("scan_id", "mrp", "net_quantity", "net_quantity_unit", "packing_date", "match_method", "match_score", "overall_status", "risk_level", F.array_join("missing_fields", ", ").alias("missing_fields"))


@query(
    f"""SELECT scan_id, nullif(barcode, '') AS detected_barcode, ref_name AS detected_product_name, coalesce(ref_brand, G.brand) AS detected_brand, reference_product_id, raw_length AS text_length, {_STATUS} AS status, coalesce(barcode, '') <> '' AS detected, V.tampering_score, V.tampering_status,
    CASE {_STATUS} WHEN 'PASS' THEN 'compliant' ELSE lower({_STATUS}) END AS overall_status, nullif(lower({_RISK}), 'none') AS risk_level, known AS reference_match, CASE WHEN missing = '' THEN '[]' ELSE '["' || replace(missing, ', ', '","') || '"]' END AS missing_fields FROM F JOIN V USING (scan_id) JOIN (SELECT scan_id, length(text) AS raw_length FROM label_scans) USING (scan_id) LEFT JOIN G USING (scan_id)""",
    "label_scans", "products", "rules", _BRAND, _ZOOMED, _FOUND, _CHECKS, _FOLD,
)
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five result tables, joined by scan. Each has a row for every scan, so none is broadcast."""
    tables = sinks.detail_tables(stored(results(spark, sf_dir, fuzzy=False), "results"))
    rows = tables["scan_records"].select("scan_id", "detected_barcode", "detected_product_name", "detected_brand", "reference_product_id", "status")
    rows = rows.join(tables["ocr_results"].select("scan_id", F.length("raw_text").cast("long").alias("text_length")).hint("merge"), "scan_id").join(tables["barcode_results"].select("scan_id", "detected").hint("merge"), "scan_id")
    rows = rows.join(tables["tampering_results"].select("scan_id", "tampering_score", F.col("status").alias("tampering_status")).hint("merge"), "scan_id")
    return rows.join(tables["compliance_results"].select("scan_id", "overall_status", "risk_level", "reference_match", "missing_fields").hint("merge"), "scan_id")


@query()
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("scan_id", "mrp", "net_quantity", "net_quantity_unit", "packing_date", "match_method", "match_score", "overall_status", "risk_level", F.array_join("missing_fields", ",").alias("missing_fields"), "explanation", "rules_version")


@query()
def scan_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.response_json(results(spark, sf_dir))


@query()
def compliance_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.detail_tables(results(spark, sf_dir))["compliance_results"]


# --- constraints, uploads

_AUDITED = """product_reference AS MATERIALIZED (SELECT CASE WHEN catalogue_pos % 19 = 0 THEN 'ref-1' ELSE reference_product_id END AS reference_product_id, CASE WHEN catalogue_pos % 17 = 0 THEN NULL ELSE brand END AS brand, product_name FROM products),
compliance_rules AS MATERIALIZED (SELECT CASE WHEN rule_pos % 4 = 0 THEN NULL ELSE rule_code END AS rule_code, rule_name, operator, CASE WHEN rule_pos % 5 = 0 THEN 'severe' ELSE severity END AS severity, is_active FROM rules),
scan_records AS MATERIALIZED (SELECT CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE o_orderkey END AS scan_id FROM orders),
barcode_results AS MATERIALIZED (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey END AS scan_id, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_partkey % 2 = 0 END AS detected FROM lineitem),
compliance_results AS MATERIALIZED (SELECT o_orderkey AS scan_id, CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'review_required' ELSE 'odd' END AS overall_status, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'none' END AS risk_level FROM orders)"""


def _row_audit(table: str, column: str, kind: str, bad: str) -> str:
    return f"SELECT '{table}' AS table_name, '{table}.{column}:{kind}' AS constraint_name, '{kind}' AS kind, count(*) AS rows, count(*) FILTER ({bad}) AS violations FROM {table}"


def _foreign_audit(table: str) -> str:
    return f"SELECT '{table}', '{table}.scan_id:foreign', 'foreign', count(scan_id), count(*) FILTER (scan_id IS NOT NULL AND scan_id NOT IN (SELECT scan_id FROM scan_records)) FROM {table}"


_AUDITS = [
    *(_row_audit("product_reference", c, "not_null", f"{c} IS NULL") for c in ("reference_product_id", "brand", "product_name")),
    *(_row_audit("compliance_rules", c, "not_null", f"{c} IS NULL") for c in ("rule_code", "rule_name", "operator", "severity", "is_active")),
    _row_audit("compliance_rules", "severity", "check", "severity NOT IN ('low', 'medium', 'high')"), _row_audit("scan_records", "scan_id", "not_null", "scan_id IS NULL"),
    _row_audit("barcode_results", "detected", "not_null", "detected IS NULL"),
    _row_audit("compliance_results", "overall_status", "check", "overall_status NOT IN ('compliant', 'non_compliant', 'review_required', 'processing', 'failed')"),
    _row_audit("compliance_results", "risk_level", "check", "risk_level NOT IN ('low', 'medium', 'high')"),
    *(f"SELECT '{t}', '{t}.{c}:unique', 'unique', count({c}), count({c}) - count(DISTINCT {c}) FROM {t}" for t, c in (("product_reference", "reference_product_id"), ("scan_records", "scan_id"))),
    _foreign_audit("barcode_results"), _foreign_audit("compliance_results"),
]


@query(" UNION ALL ".join(_AUDITS), "products", "rules", _AUDITED)
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints of five tables in which each kind is broken here and there."""
    sources = {"products": view(spark, sf_dir, "products"), "rules": view(spark, sf_dir, "rules"), "orders": table(spark, sf_dir, "orders"), "lineitem": table(spark, sf_dir, "lineitem")}
    bodies = dict(part.strip().split(" AS MATERIALIZED ", 1) for part in _AUDITED.split(",\n"))
    tables = {name: spark.sql(re.sub(r"\b(FROM) (products|rules|orders|lineitem)\b", r"\1 {\2}", body[1:-1]), **sources) for name, body in bodies.items()}
    return constraints.audit(tables)


_UPLOADS = """U AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, (p_partkey * 7919 % 12000 + 5)::bigint AS w, (p_partkey * 104729 % 9000 + 5)::bigint AS h FROM part)"""


@query(
    """SELECT k, CASE WHEN kind IN (0, 1) THEN 'png' WHEN kind IN (2, 3) THEN 'jpeg' END AS format, CASE WHEN kind < 3 THEN w WHEN kind = 3 THEN NULL END AS width, CASE WHEN kind < 3 THEN h END AS height,
    CASE WHEN k % 31 = 0 THEN 'EMPTY_UPLOAD' WHEN kind >= 3 OR w * h > 60000000 OR least(w, h) < 20 THEN 'INVALID_IMAGE' END AS error_code FROM (SELECT k, CASE WHEN k % 31 = 0 THEN 9 ELSE kind END AS kind, w, h FROM U)""",
    _UPLOADS,
)
def upload_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first bytes are made of parts: PNG, JPEG with other segments before the frame, JPEG cut off before it, a
    file of another kind, and empty ones."""
    k = F.col("p_partkey")
    w, h = k * 7919 % 12000 + 5, k * 104729 % 9000 + 5
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8), F.lit("0802000000"))
    segments = F.concat(F.lit("FFD8FFE00010"), F.repeat(F.lit("4A"), 14), F.lit("FFFFE1"), hexed(k % 500 + 2, 4), F.repeat(F.lit("C0"), (k % 500).cast("int")))
    frame = F.concat(F.lit("FFC2001108"), hexed(h, 4), hexed(w, 4), F.lit("03"))
    kind = k % 5
    content = F.when(k % 31 == 0, "").when(kind < 2, png).when(kind == 2, F.concat(segments, frame)).when(kind == 3, segments).otherwise("255044462D")
    return headers.sniffed(table(spark, sf_dir, "part").select(k.alias("k"), F.unhex(content).alias("content"))).select("k", "format", "width", "height", "error_code")


@query(
    """SELECT stage, status, CASE WHEN status = 'success' THEN n END AS rows, error_code FROM (VALUES ('field_extraction', 'success', NULL), ('product_matching', 'failed', 'REFERENCE_LOOKUP_ERROR'), ('product_matching_fallback', 'success', NULL), ('compliance_engine', 'success', NULL)) t(stage, status, error_code)
    CROSS JOIN (SELECT count(*) AS n FROM label_scans)""",
    "label_scans",
)
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a run whose catalogue has prices that cannot be read: the run goes on without references."""
    broken = view(spark, sf_dir, "products").withColumn("mrp", F.raise_error(F.concat(F.lit("no price of "), "reference_product_id")).cast("double"))
    _, stages = runs.run(view(spark, sf_dir, "label_scans"), broken, view(spark, sf_dir, "rules"), "stages", fuzzy=False)
    return stages.table().select("stage", "status", "rows", "error_code")
