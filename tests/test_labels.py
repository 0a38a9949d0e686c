"""Golden label cases: one text a row, with the raw fields expected."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.functions import dates, numbers, text
from tallymark.operators import extract

AS_OF = datetime.date(2024, 6, 30)
CASES = {
    "currency wins": ("MRP 12\nMRP Rs. 30", {"mrp_raw": "30"}),
    "rupee sign": ("M.R.P ₹45.50 incl", {"mrp_raw": "45.50"}),
    "next line": ("MRP.\nRs. 30", {"mrp_raw": "30"}),
    "next line is a declaration": ("MRP\nNet Wt 30 g", {"mrp_raw": None}),
    "too many digits": ("MRP 1234567", {"mrp_raw": None}),
    "dotted label beside": ("MRP. 30", {"mrp_raw": None}),
    "glued unit": ("MRP 30g", {"mrp_raw": None}),
    "total": ("Net Wt: 100 g + 20 g extra = 120 g", {"net_quantity_raw": "100 g + 20 g extra = 120 g"}),
    "quantity below": ("Net Weight\n250 g", {"net_quantity_raw": "250 g"}),
    "quantity after a dash": ("Net Qty - 40 ml", {"net_quantity_raw": "40 ml"}),
    "number, next line starts with a unit letter": ("Net Wt 250\nlemon", {"net_quantity_raw": "250"}),
    "packed": ("PKD: 05/03/24", {"packing_date_raw": "05/03/24"}),
    "packed, one below": ("Mfg date\n06-03-2024", {"packing_date_raw": "06-03-2024"}),
    "packed in future": ("PKD 05/03/31", {"packing_date_raw": None}),
    "packed on no day": ("PKD 31/02/24", {"packing_date_raw": None}),
    "packed without year": ("PKD 05/03", {"packing_date_raw": "05/03"}),
    "date of the next declaration": ("PKD\nUse by 05/04/24", {"packing_date_raw": "05/04/24", "use_by_raw": "05/04/24"}),
    "two below, stopped": ("Use by\nx\nBatch 05/04/24", {"use_by_raw": None}),
    "two below": ("Use by\nx\n05/04/24", {"use_by_raw": "05/04/24"}),
    "months are no date": ("Best before 6 months", {"best_before_raw": None}),
    "explicit maker": ("Mfd by: Acme Foods Pvt Ltd", {"maker_raw": "Acme Foods Pvt Ltd"}),
    "maker below": ("Manufactured by\nAcme Foods\nPrivate Limited\nPlot 4, Pune 411001", {"maker_raw": "Acme Foods Private Limited", "address_raw": "Plot 4, Pune 411001"}),
    "maker goes on": ("Packed by Acme Biscuits\nFoods Ltd", {"maker_raw": "Acme Biscuits Foods Ltd"}),
    "at form takes one line": ("C- At: Northern Specialities Limited\nSomewhere", {"maker_raw": "Northern Specialities Limited Somewhere"}),
    "split label": ("Mfd\nby:\nZed Foods Ltd", {"maker_raw": "Zed Foods Ltd"}),
    "scored line": ("hello\nGlobal Biscuits Foods Pvt Ltd\nnone", {"maker_raw": "Global Biscuits Foods Pvt Ltd"}),
    "contact is no company": ("Queries contact Acme Foods Pvt Ltd", {"maker_raw": None}),
    "contact": ("Toll free: 1800 123 4567", {"care_raw": "1800 123 4567"}),
    "e-mail": ("Customer care: help@acme.example", {"care_raw": "help@acme.example"}),
    "batch": ("Batch No. AB12/7", {"batch_raw": "AB12/7"}),
    "origin at the end": ("Country of origin: India", {"origin_raw": "India"}),
    "odd blanks": ("MRP   Rs.\t30\r\nNet Wt : 5 g", {"mrp_raw": "30", "net_quantity_raw": "5 g"}),
    "empty": ("", {"mrp_raw": None, "maker_raw": None}),
    "null": (None, {"mrp_raw": None, "address_raw": None, "care_raw": None}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "scan_id string, text string")
    return {r.scan_id: r for r in extract.raw_fields(rows, F.lit(AS_OF)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_label(found, name):
    for column, expected in CASES[name][1].items():
        assert found[name][column] == expected


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("250 g", (250.0, "g")), ("100 g + 20 g extra = 120", (120.0, "g")), ("1.5 Litres", (1.5, "l")), ("2 kg / 3 kgs", (3.0, "kg")), ("=120", (None, None)), ("none", (None, None)), (None, (None, None))],
)
def test_quantity(spark, raw, expected):
    assert tuple(one(spark, numbers.net_quantity, raw)) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("8/8/26", "2026-08-08"), ("08-08-2026", "2026-08-08"), ("5.1.70", "1970-01-05"), ("1/1/68", "2068-01-01"), ("31/02/24", None), ("AUG 2026", "2026-08-01"), ("August 2026", "2026-08-01"), ("05/03", None), ("", None), (None, None)],
)
def test_date(spark, raw, expected):
    assert one(spark, dates.parse_date, raw) == expected


def test_company_forms(spark):
    same = lambda a, b: spark.range(1).select(text.same_company(F.lit(a), F.lit(b))).first()[0]
    assert same("ACME Foods (Private) Limited", "acme foods pvt ltd")
    assert same("Acme Foods Pvt Ltd, Pune", "Acme Foods Private Limited")
    assert not same("", "Acme") and not same("Acme Foods", "Zed Foods")


def test_file_names(spark):
    assert one(spark, text.safe_file_name, "../a b(1).png") == "..a_b1.png"
    assert one(spark, text.safe_file_name, "") == "upload"


def test_article_numbers(spark):
    codes = lambda *d: spark.range(1).select(numbers.article_numbers(F.array(*map(F.lit, d)))).first()[0]
    assert codes("8901719123870") == ["8901719123870"]
    assert codes("890171912387", "0") == ["8901719123870"]
    assert codes("99 8901719123870") == ["8901719123870"]
    assert codes("8901719123871") == [] and codes("", "abc") == []


def test_queries_take_whole_texts(spark, tmp_path):
    from tallymark.plans.queries import QUERIES

    long = "".join(f"x{i}O" for i in range(100))
    spark.createDataFrame([(1, long), (2, "123 O5"), (3, "123 abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r.doc_id: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("ocr_confusions") == {1: (long.replace("O", "0"), False), 2: ("123 05", True), 3: ("123 abc", False)}
    assert rows("filename_sanitize") == {1: (long[-100:],), 2: ("123_O5",), 3: ("123_abc",)}


def test_numbers_are_shown_with_six_digits(spark):
    values = [250.0, 0.5, 1.25, 1234.5678, 999999.0, 1234567.0, 0.0001234, 0.00001234, 0.0, 100000.4, -2.5, 33.333333333]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(numbers.plain_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:g}" for v in values]


def test_numbers_are_shown_by_their_exact_values(spark):
    """Halves go to the even digit, and a number that is rounded up to the next power of ten has its exponent."""
    values = [1000005.0, 1000015.0, 1000125.0, -1000125.0, 999999.5, 999999.4, 99999.95, 9.9999996, 0.00009999999, 0.1234565, 8.333335, 100000.5, 100001.5, 2.0**60, float("inf"), float("-inf"), float("nan"), -0.0]
    got = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select(numbers.plain_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [*(f"{v:g}" for v in values), None]
