"""Label scans, products, rules and evidence derived from the supplied star schema by SQL that both engines read.

The text of a view names its tables in braces; Spark binds DataFrames to them, the oracle reads its own views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.match import small

BODY = "'890' || lpad(cast(p_partkey as string), 9, '0')"
_DIGITS = " + ".join(f"{3 if i % 2 == 0 else 1} * cast(substr({BODY}, {i}, 1) as int)" for i in range(1, 13))
BARCODE = f"{BODY} || cast((10 - ({_DIGITS}) % 10) % 10 as string)"

PRODUCTS = f"""
SELECT p_partkey AS catalogue_pos, 'ref-' || cast(p_partkey as string) AS reference_product_id, p_brand AS brand, p_name AS product_name,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE {BARCODE} END AS barcode,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_retailprice END AS mrp,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE cast(p_size * 10 as string) || ' g' END AS net_weight,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'Maker ' || cast(p_partkey % 7 as string) || ' Foods Private Limited' END AS manufacturer,
  CASE WHEN p_partkey % 3 = 0 THEN '05/03/24' ELSE '06-03-2024' END AS pkd,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '05/09/24' END AS best_before,
  CAST(NULL AS string) AS use_by,
  CASE WHEN p_partkey % 6 = 0 THEN '{{"mrp": "1,2' || cast(p_partkey % 10 as string) || '0.50"}}' WHEN p_partkey % 6 = 1 THEN 'not json' ELSE NULL END AS reference_fields_json,
  CASE WHEN p_partkey % 13 = 0 THEN 'PLACEHOLDER row' ELSE 'measured' END AS source_note
FROM {{part}}"""

_PRICE = "cast(cast(p_retailprice + CASE WHEN o_orderkey % 19 = 0 THEN 10 ELSE 0 END as decimal(10, 2)) as string)"
LABEL_SCANS = f"""
SELECT o_orderkey AS scan_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'success' END AS ocr_status,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat_ws(chr(10),
    CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE p_brand || ' ' || p_name END,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'MRP.' || chr(10) || 'Rs. ' || {_PRICE} WHEN o_orderkey % 29 = 0 THEN 'MRP 1,250' WHEN o_orderkey % 3 = 0 THEN 'MRP : ₹ ' || {_PRICE} ELSE 'MRP Rs. ' || {_PRICE} || ' incl. taxes' END,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'Net Wt: 250' WHEN o_orderkey % 31 = 0 THEN 'Net Qty 100 g + 20 g extra = 120 g' WHEN o_orderkey % 6 = 0 THEN 'Net Weight' || chr(10) || cast(p_size * 10 as string) || ' g' ELSE 'Net Wt: ' || cast(p_size * 10 as string) || ' g' END,
    CASE o_orderkey % 6 WHEN 0 THEN 'Mfd by: Maker ' || substr('ABCDEFG', cast(o_orderkey % 7 as int) + 1, 1) || ' Foods Pvt Ltd' WHEN 1 THEN 'Manufactured by' || chr(10) || 'Acme Foods Private Limited' || chr(10) || 'Plot 5, Pune 411001' WHEN 2 THEN 'at: Northern Food Specialities Limited' || chr(10) || 'Sector 9, Delhi' WHEN 3 THEN 'Packed' || chr(10) || 'by' || chr(10) || 'Zed Products Industries Ltd' WHEN 4 THEN 'Global Biscuits Foods Pvt Ltd' ELSE NULL END,
    CASE o_orderkey % 8 WHEN 0 THEN 'PKD: 05/03/24' WHEN 1 THEN 'Mfg Date' || chr(10) || '06-03-2024' WHEN 2 THEN 'Pkd 09/09/2031' WHEN 3 THEN 'PKD' || chr(10) || 'USE BY: 08/10/24' WHEN 4 THEN 'PKD 31/02/24' WHEN 5 THEN 'pkd 7.3.24' ELSE NULL END,
    CASE o_orderkey % 9 WHEN 0 THEN 'Use by 05/09/24' WHEN 1 THEN 'Best before' || chr(10) || 'see side' || chr(10) || '01/12/2024' WHEN 2 THEN 'Best before 6 months' WHEN 3 THEN 'Use By' || chr(10) || 'x' || chr(10) || 'Batch 5' || chr(10) || '03/04/25' ELSE NULL END,
    CASE o_orderkey % 4 WHEN 0 THEN 'Consumer Care: 1800 123 4567' WHEN 1 THEN 'customer care care@acme.example' ELSE NULL END,
    CASE WHEN o_orderkey % 10 < 6 THEN 'Batch No. AB' || cast(o_orderkey % 97 as string) || '/7' ELSE NULL END,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Country of Origin: India' ELSE NULL END) END AS text,
  CASE WHEN o_orderkey % 6 = 0 THEN 'pkd 04/03/24' ELSE NULL END AS zoom_text,
  CASE WHEN o_orderkey % 4 = 0 THEN {BARCODE} WHEN o_orderkey % 4 = 1 THEN '' ELSE NULL END AS barcode,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unavailable' ELSE 'success' END AS tampering_status,
  cast(o_orderkey * 37 % 101 as double) / 100 AS tampering_score
FROM {{orders}} JOIN {{part}} ON p_partkey = o_orderkey % (SELECT count(*) FROM {{part}})"""

#: The shipped rules.
_RULES = [
    ("LM-001", "MRP declaration present", "mrp", "field_present", None, "high", "Every packaged commodity must declare the Maximum Retail Price."),
    ("LM-002", "Net quantity declaration present", "net_quantity", "field_present", None, "high", "Every packaged commodity must declare its net quantity."),
    ("LM-003", "Manufacturer/packer/importer address present", "manufacturer_address", "field_present", None, "high", "The name and address of the manufacturer, packer or importer must be declared."),
    ("LM-004", "Manufacturing/packing date or use-by date present", "manufacturing_date_or_use_by", "any_field_present", "manufacturing_date,use_by,best_before", "medium", "A month/year of manufacture, packing, use-by, or best-before date must be declared."),
    ("LM-005", "Consumer care contact present", "consumer_care_contact", "field_present", None, "medium", "Consumer complaint/care contact details must be declared."),
    ("LM-006", "Zero-declaration high-risk flag", "declaration_count", "min_declarations", "2", "high", "Near-zero mandatory declarations detected on the label - likely a completely unlabeled or non-compliant product."),
    ("TP-001", "No significant tampering evidence", "tampering_score", "tampering_score_below", "0.55", "high", "The image-tampering heuristic should not report a high anomaly score."),
    ("REF-001", "Reference MRP consistency", "mrp", "reference_field_match", "mrp", "high", "MRP should match the known reference value for this product."),
    ("REF-002", "Reference net quantity consistency", "net_quantity", "reference_field_match", "net_quantity", "medium", "Net quantity should match the known reference value for this product."),
    # not of the shipped set: one row for each further case
    ("X-001", "Batch date", "use_by", "reference_field_match", "use_by", "low", None),
    ("X-002", "Unknown operator", "mrp", "no_such_operator", None, "low", None),
    ("X-003", "Switched off", "mrp", "field_present", None, "high", None),
    ("X-004", "Starts today", "batch", "field_present", None, "low", None),
    ("X-005", "Ended yesterday", "batch", "field_present", None, "low", None),
    ("X-006", "Starts tomorrow", "batch", "field_present", None, "low", None),
]
_DATES = {"X-004": ("2024-06-30", None), "X-005": (None, "2024-06-29"), "X-006": ("2024-07-01", None)}


def _text(v: str | None) -> str:
    return "cast(NULL as string)" if v is None else "'" + v.replace("'", "''") + "'"


def _rule(pos: int, r: tuple) -> str:
    start, end = (f"cast({_text(d)} as date)" for d in _DATES.get(r[0], (None, None)))
    names = ("rule_code", "rule_name", "field_name", "operator", "expected_value", "severity", "description")
    columns = ", ".join(f"{_text(v)} AS {n}" for n, v in zip(names, r))
    return f"SELECT {pos} AS rule_pos, {columns}, {start} AS effective_from, {end} AS effective_to, '{1 + pos // 9}' AS version, {'false' if r[0] == 'X-003' else 'true'} AS is_active"


RULES = "\nUNION ALL ".join(_rule(i, r) for i, r in enumerate(_RULES))

#: A rule for each part: switched on, off or neither, with and without days.
RULE_BOOK = """
SELECT 'R-' || cast(p_partkey as string) AS rule_code, CASE p_partkey % 3 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' ELSE 'batch' END AS field_name, 'field_present' AS operator, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
  cast(CASE p_partkey % 5 WHEN 1 THEN '2024-06-30' WHEN 2 THEN '2024-07-01' ELSE NULL END as date) AS effective_from, cast(CASE p_partkey % 7 WHEN 1 THEN '2024-06-30' WHEN 2 THEN '2024-06-29' ELSE NULL END as date) AS effective_to,
  CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN NULL ELSE 'v' || cast(p_size as string) END AS version, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 4 <> 0 END AS is_active
FROM {part}"""

EVIDENCE = """
SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'success' END AS ocr_status,
  o_orderkey % 7 <> 0 AS p_mrp, o_orderkey % 11 <> 0 AS p_net, o_orderkey % 5 <> 0 AS p_addr, o_orderkey % 3 = 0 AS p_mfg, o_orderkey % 4 = 0 AS p_use, o_orderkey % 13 = 0 AS p_best, o_orderkey % 2 = 0 AS p_care,
  CASE WHEN o_orderkey % 10 = 3 THEN 'For queries contact us' ELSE 'Acme Foods Pvt Ltd, Pune' END AS address,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unavailable' ELSE 'success' END AS tampering_status, cast(o_orderkey * 37 % 101 as double) / 100 AS tampering_score,
  o_orderkey % 8 <> 0 AS reference_found,
  CASE o_orderkey % 6 WHEN 0 THEN 'MISMATCH' WHEN 1 THEN 'NOT_AVAILABLE' WHEN 2 THEN 'REVIEW_REQUIRED' ELSE 'MATCH' END AS c_mrp,
  CASE o_orderkey % 5 WHEN 0 THEN 'MISMATCH' WHEN 1 THEN CAST(NULL AS string) ELSE 'MATCH' END AS c_net,
  CASE o_orderkey % 4 WHEN 0 THEN 'ACME Foods (Private) Limited' WHEN 1 THEN 'Zed Foods Private Limited' ELSE CAST(NULL AS string) END AS known_maker
FROM {orders}"""

OCR_WORDS = """
SELECT l_orderkey AS scan_id, cast(l_partkey % 2 as int) AS pass_no, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) AS pos,
  cast(l_suppkey % 2 as int) AS block_num, 1 AS par_num, cast(l_linenumber % 3 as int) AS line_num,
  CASE WHEN l_partkey % 13 = 0 THEN '--' WHEN l_partkey % 17 = 0 THEN ' ' ELSE l_returnflag || cast(l_partkey as string) END AS text,
  cast((l_partkey * 7 + l_suppkey) % 102 - 1 as double) AS conf, cast(l_partkey % 50 as double) AS "left", cast(l_linenumber % 3 * 20 as double) AS top, cast(30 as double) AS width, cast(12 as double) AS height
FROM {lineitem}"""

BARCODE_CANDIDATES = """
SELECT l_orderkey AS scan_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) AS pos,
  CASE WHEN l_partkey % 7 = 0 THEN ' ' WHEN l_partkey % 5 = 0 THEN 'A-' || cast(l_partkey % 10 as string) ELSE cast(l_partkey % 3 + 8901234567 as string) END AS value,
  CASE l_suppkey % 4 WHEN 0 THEN 'EAN13' WHEN 1 THEN 'CODE128' WHEN 2 THEN NULL ELSE 'PDF417' END AS type,
  0 AS x, 0 AS y, cast(l_quantity as int) AS w, cast(l_linenumber as int) + 5 AS h
FROM {lineitem}"""

REGIONS = """
SELECT l_orderkey AS scan_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) AS pos, 10 AS x, cast(l_partkey % 600 as int) AS y,
  cast(l_quantity * 8 as int) AS w, cast(20 + l_partkey % 90 as int) AS h, 400 AS img_w, 700 AS img_h, cast((l_suppkey + l_partkey) % 40 as double) / 8 AS gradient_ratio
FROM {lineitem}"""

CONTOURS = """
SELECT l_orderkey AS scan_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) AS pos, 0 AS x, 0 AS y, cast(l_quantity as int) * 2 AS w, cast(10 + l_partkey % 60 as int) AS h, cast(3 + l_linenumber % 2 as int) AS vertices, cast(80 + l_suppkey % 20 as double) / 100 AS rectangularity, cast(40000 as bigint) AS image_area
FROM {lineitem}"""

TILES = """
SELECT l_suppkey % 50 AS scan_id, cast(l_linenumber as int) AS tile_x, cast(l_partkey % 64 as int) AS tile_y, cast(l_partkey % 12 as double) / 100 AS edge_density, cast(l_partkey % 200 as double) / 40 AS residual_median
FROM {lineitem}"""

VIEWS = {
    "products": PRODUCTS, "label_scans": LABEL_SCANS, "rules": RULES, "rule_book": RULE_BOOK, "evidence": EVIDENCE, "ocr_words": OCR_WORDS,
    "barcode_candidates": BARCODE_CANDIDATES, "regions": REGIONS, "contours": CONTOURS, "tiles": TILES,
}
TABLES = ("orders", "part", "lineitem")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. The texts that views make of its rows are far larger than the rows; a table of fewer files than the
    cluster has cores is therefore dealt over all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "orders" and len(rows.inputFiles()) < cores else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace('"left"', "`left`")
    used = {t: source(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    if name == "label_scans":
        used["part"] = small(used["part"])  # joined with orders
    literal = re.sub(r"\{(?!(?:%s)\})" % "|".join(TABLES), "{{", re.sub(r"(?<!orders)(?<!part)(?<!lineitem)\}", "}}", text))
    return spark.sql(literal, **used)


def oracle_view(name: str) -> str:
    text = VIEWS[name]
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text
