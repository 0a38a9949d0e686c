"""Products, comparisons, rules, tables, sources and the stream."""

from __future__ import annotations

import collections
import datetime
import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.context import RunContext
from tallymark.functions.text import comma_list
from tallymark.operators import barcode, compare, extract, match, ocr, rules, vision
from tallymark.plans import pipeline
from tallymark.plans.fixtures import view
from tallymark.sources import adapters, buckets, readers, sinks
from tallymark.storage import stored

AS_OF = datetime.date(2024, 6, 30)
PRODUCTS = "catalogue_pos long, reference_product_id string, brand string, product_name string, barcode string, mrp double, net_weight string, manufacturer string, pkd string, best_before string, use_by string, reference_fields_json string"


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (0, "p0", "Acme", "Glucose", "8901719123870", 30.0, "250 g", "Acme Foods Private Limited", "05/03/24", None, None, None),
        (1, "p1", "acme", "Cream", "8901719123870", None, None, None, None, None, None, '{"mrp": "1,250.50"}'),
        (2, "p2", "Zed", "Cola", "", 45.0, "1 l", "", None, None, None, "[1]"),
    ]
    return spark.createDataFrame(rows, PRODUCTS)


def scans(spark, *rows):
    full = [(i, datetime.datetime(2024, 6, 1), status, text, None, code, "success", 0.1) for i, (text, code, status) in enumerate(rows)]
    return spark.createDataFrame(full, "scan_id long, created_at timestamp, ocr_status string, text string, zoom_text string, barcode string, tampering_status string, tampering_score double")


def test_match_cascade(spark, products):
    s = scans(spark, ("x", "8901719123870", "success"), ("ACME glucose biscuits", None, "success"), ("zed something", None, "success"), ("nothing", "", "success"), (None, None, "failed"))
    s = s.join(match.known_brand(s, products), "scan_id", "left")
    got = {r.scan_id: (r.reference_product_id, r.match_method, r.match_score) for r in match.matched(s, products).collect()}
    assert got == {0: ("p0", "barcode", 1.0), 1: ("p0", "fuzzy", 0.85), 2: (None, None, 0.0), 3: (None, None, 0.0), 4: (None, None, 0.0)}


def test_match_cascade_goes_on_to_similarity(spark, products):
    from difflib import SequenceMatcher

    texts = ["acne glucose", "Azme Cream", "ced cola", "nothing like it", "zed something", None]
    s = scans(spark, *((t, None, "success") for t in texts))
    s = s.join(match.known_brand(s, products), "scan_id", "left")
    got = {r.scan_id: (r.reference_product_id, r.match_method, r.match_score) for r in match.matched(s, products).collect()}
    labels = [("p0", "acme glucose"), ("p1", "acme cream"), ("p2", "zed cola")]
    for i, t in enumerate(texts):
        ratio, name = max(((round(SequenceMatcher(None, v, (t or "").lower()).ratio(), 3), n) for n, v in labels), key=lambda x: x[0])
        assert got[i] == ((name, "fuzzy", ratio) if ratio >= 0.72 else (None, None, 0.0))
    assert [got[i][0] for i in range(3)] == ["p0", "p1", "p2"]


def test_many_brands_give_the_same(spark, products):
    s = scans(spark, ("ACME glucose", None, "success"), ("unzedded", None, "success"), ("nothing", None, "success"))
    rows = lambda few: sorted(map(tuple, match.known_brand(s, products, few).collect()))
    assert rows(0) == rows(1000) == [(0, "Acme"), (1, "Zed")]


def test_similarity_needs_no_cross_join(spark, products):
    s = spark.createDataFrame([(1, "acme glucos"), (2, "completely different"), (3, None)], "scan_id long, text string")
    found = match.by_similarity(s, products)
    assert [(r.scan_id, r.reference_product_id) for r in found.collect()] == [(1, "p0")]
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_names_are_found_by_their_rarest_gram(spark, monkeypatch):
    """One brand of 50,000 products: a text meets the few names whose rarest gram it holds, not all of them."""
    names = spark.range(50_000).select(
        F.col("id").alias("catalogue_pos"), F.concat(F.lit("p"), F.col("id")).alias("reference_product_id"), F.lit("Acme").alias("brand"),
        F.when(F.col("id") % 1000 == 0, F.concat(F.lit("X"), F.col("id") / 1000 % 7)).otherwise(F.concat(F.lit("Glucose biscuit no. "), F.col("id"), F.lit(" Family"))).alias("product_name"),
    )
    index = names.sparkSession.createDataFrame(match.name_index(names).collect(), match.name_index(names).schema).cache()
    rows = [(k, f"ACME some text, glucose Biscuit NO. {k * 37 % 60_000} family pack", "acme") for k in range(1000)] + [(5000, "acme x3.0 glucose biscuit", "ACME"), (5001, None, "Acme"), (5002, "glucose", "other"), (5003, "", "acme")]
    s = spark.createDataFrame(rows, "scan_id long, text string, brand string")
    assert match.name_probes(s, index).count() <= 5 * len(rows)
    wanted = {k: f"p{k * 37 % 60_000}" for k in range(1000) if k * 37 % 60_000 < 50_000 and k * 37 % 60_000 % 1000} | {5000: "p3000"}
    found = lambda: {r.scan_id: r.reference_product_id for r in match.by_name(s, names, index).collect()}
    assert found() == wanted
    monkeypatch.setattr(match, "BROADCAST_ROWS", 10)
    assert found() == wanted


def test_brand_scores_by_force(spark):
    import random

    own = random.Random(4)
    word = lambda: "".join(own.choice("abAB é") for _ in range(own.randint(0, 9)))
    shop = [(i, f"p{i}", own.choice(["Acme", "zed", "ACME", "", None]), own.choice([word(), None])) for i in range(300)]
    rows = [(i, own.choice([word() + word() + word(), None]), own.choice(["acme", "Zed", "none"])) for i in range(200)]
    table = spark.createDataFrame(shop, "catalogue_pos long, reference_product_id string, brand string, product_name string")
    got = {r.scan_id: (r.reference_product_id, r.score) for r in match.by_brand(spark.createDataFrame(rows, "scan_id long, text string, brand string"), table).collect()}
    for i, text, brand in rows:
        scored = [(0.85 if text is not None and name is not None and name.lower() in text.lower() else 0.6, -at, p) for at, p, b, name in shop if b and b.lower() == brand.lower()]
        assert got.get(i) == ((max(scored)[2], max(scored)[0]) if scored else None)


def test_similarity_by_force(spark):
    """2,000 labels and 2,000 texts, most of them unlike; the prefixes leave few pairs."""
    import random
    from difflib import SequenceMatcher

    own = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäß 0123456789"
    label = lambda: "".join(own.choice(letters) for _ in range(own.randint(4, 24)))
    shop = [(i, f"p{i}", "B", label()) for i in range(2000)]

    def damaged(text):
        return "".join(own.choice(letters) if own.random() < 0.2 else c.upper() if own.random() < 0.3 else c for c in text)

    rows = [(i, damaged("B " + shop[own.randrange(2000)][3]) if i % 2 else label()) for i in range(2000)]
    rows += [(3000, "b"), (3001, "B" * 250), (3002, ""), (3003, None)]
    table, texts = spark.createDataFrame(shop, "catalogue_pos long, reference_product_id string, brand string, product_name string"), spark.createDataFrame(rows, "scan_id long, text string")
    labels = table.select("catalogue_pos", F.lower("brand").alias("tm_brand"), F.concat_ws(" ", "brand", "product_name").alias("tm_label"), F.struct("catalogue_pos", "reference_product_id").alias("tm_first"))
    pairs = match.similar_pairs(texts.where("text <> ''").select(F.lit(None).cast("string").alias("tm_own"), F.col("text").alias("tm_text")), labels)
    assert pairs.count() <= 0.01 * 2000 * 2000
    got = {r.scan_id: (r.reference_product_id, r.score) for r in match.by_similarity(texts, table).collect()}
    bags = [(collections.Counter(f"B {name}".lower()), f"B {name}".lower(), p) for _, p, _, name in shop]
    for i, text in rows:
        best, low = (0.0, None), (text or "")[:200].lower()
        bag = collections.Counter(low)
        for other, name, p in bags:
            if low and 2 * sum((bag & other).values()) >= 0.7199 * (len(low) + len(name)):
                best = max(best, (SequenceMatcher(None, name, low).ratio(), p), key=lambda x: x[0])
        assert got.get(i) == ((best[1], round(best[0], 3)) if best[0] >= 0.72 else None)


def test_comparison_ladder(spark):
    pair = lambda a, b, f: spark.range(1).select(f(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("e")).first().e.status
    assert pair(None, None, compare.compare_text) == "NOT_AVAILABLE"
    assert pair(None, "a", compare.compare_text) == "REVIEW_REQUIRED"
    assert pair(" A", "a", compare.compare_text) == "MATCH"
    assert pair("30", "30.005", compare.compare_number) == "MATCH"
    assert pair("30", "31", compare.compare_number) == "MISMATCH"
    assert pair("5/3/24", "05-03-2024", compare.compare_date) == "MATCH"
    quantity = spark.range(1).select(compare.compare_quantity(F.lit(1.0), F.lit("kg"), F.lit("1 kg"), F.lit("1000 g")).alias("e")).first().e
    assert (quantity.status, quantity.live, quantity.reference) == ("MISMATCH", "1 kg", "1000 g")


def test_evaluation(spark, sf, products):
    label = "Acme Glucose\nMRP Rs. 30\nNet Wt: 250 g\nMfd by: Acme Foods Pvt Ltd, Plot 4, Pune\nPKD 05/03/24\nConsumer care: 1800 123 4567"
    s = scans(spark, (label, "8901719123870", "success"), ("blank", None, "success"), (None, None, "failed"))
    out = {r.scan_id: r for r in pipeline.evaluate(s, products, view(spark, sf, "rules")).collect()}
    assert out[1].overall_status == "NON_COMPLIANT" and out[1].risk_level == "HIGH" and out[1].warnings == ["Near-zero declarations found - likely a completely unlabeled or non-compliant product."]
    assert out[1].missing_fields[:3] == ["mrp", "net_quantity", "manufacturer_address"]
    assert out[2].overall_status == "REVIEW_REQUIRED" and out[2].risk_level == "MEDIUM"
    assert out[0].comparisons is None if "comparisons" in out[0] else True
    assert out[0].match_method == "barcode" and set(out[0].matched_fields) >= {"mrp", "net_quantity"}
    checks = {c.rule_code: c.status for c in out[0].rule_results}
    assert checks["LM-001"] == checks["LM-006"] == checks["TP-001"] == checks["REF-001"] == "PASS"
    assert "X-003" not in checks and "X-005" not in checks and "X-006" not in checks and "X-004" in checks
    body = json.loads(pipeline.response_json(pipeline.evaluate(s, products, view(spark, sf, "rules"))).where("scan_id = 1").first().response)
    assert body["product"]["match_method"] is None and body["compliance"]["overall_status"] == "NON_COMPLIANT" and body["status"] == "completed"
    assert list(body["extracted_fields"]) == list(sinks.FIELDS) and body["extracted_fields"]["mrp"] == {"value": None, "unit": None, "raw": None, "found": False}
    assert body["warnings"][-1].startswith("No matching reference product") and body["ocr"]["raw_text"] == "blank"


def test_reference_prices_as_printed(spark, sf, products):
    """Prices with signs and commas in the catalogue's texts compare as numbers."""
    shop = products.where("catalogue_pos = 1").withColumn("barcode", F.lit("1")).withColumn("reference_fields_json", F.lit('{"mrp": "₹1,250.50"}'))
    s = scans(spark, ("MRP Rs. 1250.50", "1", "success"), ("MRP Rs. 1251", "1", "success"))
    got = {r.scan_id: r for r in pipeline.evaluate(s, shop, view(spark, sf, "rules")).collect()}
    assert "mrp" in got[0].matched_fields and "mrp" in got[1].mismatched_fields


def test_order_and_partitions_do_not_matter(spark, sf, products):
    s = view(spark, sf, "label_scans").limit(200).cache()
    rows = lambda d: sorted(map(tuple, pipeline.evaluate(d, products, view(spark, sf, "rules")).select("scan_id", "overall_status", "explanation").collect()))
    assert rows(s) == rows(s.orderBy(F.desc("scan_id")).repartition(5))


def test_rule_plan_has_no_python(spark, sf):
    from tallymark.plans.queries import QUERIES

    for name in ("rule_checks", "mrp_extract", "manufacturer_address", "overall_status"):
        assert "Python" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_rules_are_judged_without_a_shuffle(spark, sf, tmp_path):
    from tallymark.plans.queries import gathered

    gathered(spark, sf).write.parquet(str(tmp_path / "evidence"))
    seen = spark.read.parquet(str(tmp_path / "evidence"))
    table = rules.active(view(spark, sf, "rules"), F.lit(AS_OF))
    found = rules.folded(rules.judged(seen, table))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan and "RoundRobin" not in plan
    rows = lambda d: sorted(map(str, d.select("scan_id", "overall_status", "risk_level", "missing_fields", "rule_results", "explanation", "warnings", "rules_version").collect()))
    few, rules.MAX_RULES = rules.MAX_RULES, 3
    try:
        assert rows(rules.folded(rules.judged(seen, table))) == rows(found)
    finally:
        rules.MAX_RULES = few


def test_makers_that_match_after_normalising_are_shown_as_matches(spark, sf, products):
    shop = products.where("catalogue_pos = 0").withColumn("manufacturer", F.lit("Acme Foods (Private) Limited"))
    s = scans(spark, ("MRP Rs. 30\nMfd by: Acme Foods Pvt Ltd", "8901719123870", "success"))
    got = pipeline.evaluate(s, shop, view(spark, sf, "rules")).first()
    assert (got.matched_fields["manufacturer"].match, got.matched_fields["manufacturer"].status) == (True, "MATCH") and "manufacturer" not in got.mismatched_fields
    assert got.explanation.endswith(f"Overall risk level: {got.risk_level}.") and list(got.matched_fields)[0] == "mrp"


def test_ids_run_on(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sinks.numbered(rows, [F.asc("k")], 10).collect()
    assert sorted((r.k, r.scan_id) for r in got) == [(k, k + 11) for k in range(1000)]


def test_ids_run_on_with_a_payload(spark):
    rows = spark.range(0, 400_000, 1, 7).select((F.col("id") * 7919 % 400_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("payload"))
    got = sinks.numbered(rows, [F.asc("k")])
    sums = got.agg(F.countDistinct("scan_id"), F.min("scan_id"), F.max("scan_id"), F.count_if(F.col("scan_id") != F.col("k") + 1), F.countDistinct("payload")).first()
    assert tuple(sums) == (400_000, 1, 400_000, 0, 400_000)


def test_batches_claim_ids_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    batch = lambda low, high: {"t": spark.range(low, high).select((-F.col("id")).alias("k"))}
    assert sinks.append_batch(batch(0, 10), folder, "a", [F.asc("k")]) and sinks.append_batch(batch(10, 15), folder, "b", [F.asc("k")])
    assert not sinks.append_batch(batch(0, 10), folder, "a", [F.asc("k")])
    assert sinks.claimed(spark, folder, "c", 4)["first"] == 16  # a batch that stops after its claim and before its commit
    assert sinks.append_batch(batch(20, 22), folder, "d", [F.asc("k")]) and sinks.append_batch(batch(30, 34), folder, "c", [F.asc("k")])
    with pytest.raises(ValueError):
        sinks.claimed(spark, folder, "c", 5)
    got = sorted((r.scan_id, r.k) for r in sinks.committed(spark, folder, "t").collect())
    assert got == [(i + 1, k) for i, k in enumerate([*range(-9, 1), *range(-14, -9), *range(-33, -29), -21, -20])]


def test_writers_at_the_same_time_get_ranges_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: sinks.claimed(spark, str(tmp_path), f"batch {k}", k + 1), range(12)))
    taken = sorted(i for e in got for i in range(e["first"], e["first"] + e["rows"]))
    assert taken == list(range(1, sum(range(1, 13)) + 1))


def test_a_failed_table_leaves_no_batch(spark, tmp_path):
    from tallymark.sources.commits import Log

    folder = str(tmp_path / "store")
    assert sinks.append_batch({n: spark.range(2) for n in "abcde"}, folder, "first")
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.append_batch({"a": spark.range(3), "b": spark.range(3), "c": broken, "d": spark.range(3), "e": spark.range(3)}, folder, "second")
    assert [sinks.committed(spark, folder, n).count() for n in "abcde"] == [2] * 5
    assert sinks.append_batch({n: spark.range(3) for n in "abcde"}, folder, "second") and [sinks.committed(spark, folder, n).count() for n in "abcde"] == [5] * 5
    assert not Log(spark, f"{folder}/commits").create(1, {"key": "other"}) and len(Log(spark, f"{folder}/commits").entries()) == 2
    with pytest.raises(ValueError):
        sinks.committed(spark, folder, "f")


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("n"), F.lit("x").alias("s"))
    first = buckets.upsert(rows, folder, "key")
    kept = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    second = buckets.upsert(spark.createDataFrame([("k7", None, "y"), ("new", 1, None)], "key string, n long, s string"), folder, "key")
    changed = [b for b in second["buckets"] if second["buckets"][b] != first["buckets"].get(b)]
    assert 1 <= len(changed) <= 2 and len(first["buckets"]) == buckets.BUCKETS
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    wanted = {f"k{i}": (i, "x") for i in range(5000)} | {"k7": (7, "y"), "new": (1, None)}
    assert {r.key: (r.n, r.s) for r in buckets.read(spark, folder).collect()} == wanted
    assert buckets.read(spark, folder, 0).count() == 5000 and buckets.read(spark, folder).columns == ["key", "n", "s"]
    with pytest.raises(ValueError):
        buckets.read(spark, str(tmp_path / "none"))


def test_tables(spark, sf, products, tmp_path):
    out = pipeline.evaluate(scans(spark, ("blank", None, "success")), products, view(spark, sf, "rules"))
    sinks.append(out, str(tmp_path))
    for name, rows in sinks.detail_tables(out).items():
        assert rows.schema.names == sinks.spark_schema(name).names and sinks.committed(spark, str(tmp_path), name).count() == 1
    assert sinks.committed(spark, str(tmp_path), "scan_records").first().status == "NON_COMPLIANT"
    row = sinks.committed(spark, str(tmp_path), "compliance_results").first()
    assert (row.overall_status, row.risk_level) == ("non_compliant", "high")
    twice = sinks.upsert(products.select("reference_product_id", "mrp"), spark.createDataFrame([("p0", None), ("p9", 9.0)], "reference_product_id string, mrp double"), "reference_product_id")
    assert sorted(map(tuple, twice.collect()), key=repr) == [("p0", 30.0), ("p1", None), ("p2", 45.0), ("p9", 9.0)]


def test_json_sources(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"rule_code": "A", "is_active": True, "effective_to": "2024-06-30"}, {"rule_code": "B", "is_active": False}]))
    got = rules.active(readers.rules_json(spark, str(path)), F.lit(AS_OF))
    assert [r.rule_code for r in got.collect()] == ["A"]
    assert readers.products_json(spark, str(tmp_path / "absent.json")).count() == 0


def png(pixels):
    import struct
    import zlib

    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_adapters(spark, tmp_path):
    red = png([[(255, 0, 0)] * 64] * 64)
    (tmp_path / "red.png").write_bytes(red)
    (tmp_path / "small.png").write_bytes(png([[(0, 0, 0)] * 5] * 5))
    (tmp_path / "cut.png").write_bytes(red[:40])
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.images(spark, str(tmp_path)).collect()}
    assert got["red.png"].error_code is None and bytes(got["red.png"].data[:3]) == b"\0\0\xff"
    assert got["small.png"].error_code == got["cut.png"].error_code == readers.INVALID
    files = {r.name: r for r in readers.uploads(spark, str(tmp_path), RunContext(max_upload_bytes=100)).collect()}
    assert files["cut.png"].error_code is None and files["red.png"].error_code == readers.TOO_LARGE
    images = readers.images(spark, str(tmp_path)).where("error_code is null").withColumn("scan_id", F.lit(1).cast("long"))
    tiles = adapters.run(images, "tiles").collect()
    assert [(t.tile_x, t.tile_y, t.edge_density, t.residual_median, t.status) for t in tiles] == [(0, 0, 0.0, 0.0, "success")]
    broken = adapters.run(images.withColumn("height", F.lit(7)), "tiles").collect()
    assert [(t.scan_id, t.tile_x, t.status, t.error_code) for t in broken] == [(1, None, "failed", "TAMPERING_PROCESSING_ERROR")] and "reshape" in broken[0].error
    assert adapters.run(images, "no such engine").count() == 0


def test_earliest_unique_code(spark):
    rows = [(1, 1, 0, "12"), (1, 2, 0, "8901719123870"), (1, 3, 0, "4006381333931"), (2, 1, 0, "8901719123870"), (2, 1, 1, "4006381333931"), (3, 1, 0, "x")]
    got = barcode.rebuilt(spark.createDataFrame(rows, "scan_id long, region_no int, pos int, digits string")).collect()
    assert [tuple(r) for r in got] == [(1, "8901719123870", 2)]


def test_empty_inputs(spark, sf, products):
    none = scans(spark, ("x", None, "success")).limit(0)
    assert pipeline.evaluate(none, products, view(spark, sf, "rules")).count() == 0
    assert ocr.best_pass(ocr.scan_texts(ocr.text_lines(view(spark, sf, "ocr_words").limit(0)))).count() == 0
    assert vision.tampering(view(spark, sf, "contours").limit(0), view(spark, sf, "tiles").limit(0)).count() == 0


def test_stream(spark, sf, products, tmp_path):
    from tallymark.streaming.scans import SCANS, start

    scans(spark, ("MRP Rs. 30", None, "success"), ("blank", None, "success")).write.json(str(tmp_path / "in"))
    run = start(spark, str(tmp_path / "in"), products, view(spark, sf, "rules"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert run.awaitTermination(180)
    assert sinks.committed(spark, str(tmp_path / "out"), "scan_records").count() == 2
    # the batch comes again, as after a failure between writing and its record
    again = pipeline.evaluate(spark.read.schema(SCANS).json(str(tmp_path / "in")), products, view(spark, sf, "rules"))
    assert not sinks.append(again, str(tmp_path / "out"), "stream-0")
    assert sinks.committed(spark, str(tmp_path / "out"), "compliance_results").count() == 2


def test_late_scans_go_to_a_table_of_their_own(spark, sf, products, tmp_path):
    from tallymark.streaming.scans import start

    def arrive(name, *rows):
        full = [(i, datetime.datetime(2024, 6, day), "success", "MRP Rs. 30", None, None, "success", 0.1) for i, day in rows]
        spark.createDataFrame(full, "scan_id long, created_at timestamp, ocr_status string, text string, zoom_text string, barcode string, tampering_status string, tampering_score double").coalesce(1).write.json(str(tmp_path / "in" / name))
        run = start(spark, str(tmp_path / "in/*"), products, view(spark, sf, "rules"), str(tmp_path / "out"), str(tmp_path / "state"), late=datetime.timedelta(days=5))
        assert run.awaitTermination(180)

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    arrive("a", (1, 1), (2, 10))
    arrive("b", (3, 4), (4, 5), (5, 20))
    rows = lambda name: sorted(r.scan_id for r in sinks.committed(spark, str(tmp_path / "out"), name).collect())
    assert rows("scan_records") == rows("ocr_results") == [1, 2, 4, 5] and rows("late_scans") == [3]
    assert {p.name for p in shared.iterdir()} == before  # batches leave nothing behind


def test_uploads_of_one_content_are_kept_once(spark, tmp_path):
    import os

    from tallymark.streaming.uploads import start

    def arrive(*files):
        (tmp_path / "in").mkdir(exist_ok=True)
        for name, content, hour in files:
            (tmp_path / "in" / name).write_bytes(content)
            os.utime(tmp_path / "in" / name, (1_700_000_000 + 3600 * hour,) * 2)
        assert start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "2 hours").awaitTermination(180)

    red = png([[(255, 0, 0)] * 64] * 64)
    arrive(("a.png", red, 0), ("b.png", red, 0), ("bad name!.txt", b"text", 0))
    arrive(("c.png", red, 1), ("d.png", red[:20], 1))
    got = {r.name: (r.format, r.width, r.error_code) for r in sinks.committed(spark, str(tmp_path / "out"), "uploads").collect()}
    assert len(got) == 3 and got["bad_name.txt"] == (None, None, "INVALID_IMAGE") and got["d.png"] == ("png", 64, "INVALID_IMAGE")
    assert ("png", 64, None) in got.values() and "c.png" not in got


def test_headers_are_read_before_decoders(spark):
    from tallymark.sources.headers import sniffed

    def jpeg(w, h, *segments):
        return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + (len(d) + 2).to_bytes(2, "big") + d for m, d in segments) + b"\xff\xff\xc1\x00\x11\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes(10)

    files = [
        ("png", png([[(0, 0, 0)] * 30] * 20)), ("small", png([[(0, 0, 0)] * 30] * 19)), ("bomb", png([[(0, 0, 0)] * 30] * 20)[:16] + (60_001).to_bytes(4, "big") + (1_000).to_bytes(4, "big") + bytes(9)),
        ("jpeg", jpeg(640, 480, (0xE0, b"JFIF"), (0xE1, b"\xff\xc0" * 20_000), (0xDB, bytes(65)))), ("many", jpeg(25, 31, *[(0xE2, b"x")] * 100)), ("endless", jpeg(25, 31, *[(0xE2, b"x")] * 300)), ("cut", jpeg(640, 480)[:9]),
        ("gif", b"GIF89a" + (300).to_bytes(2, "little") + (200).to_bytes(2, "little")), ("bmp", b"BM" + bytes(16) + (70).to_bytes(4, "little") + (-80).to_bytes(4, "little", signed=True)),
        ("none", b""), ("null", None), ("large", bytes(13 * 1024 * 1024)), ("text", b"hello"),
    ]
    got = {r.name: (r.format, r.width, r.height, r.error_code) for r in sniffed(spark.createDataFrame(files, "name string, content binary")).collect()}
    bad = "INVALID_IMAGE"
    assert got == {
        "png": ("png", 30, 20, None), "small": ("png", 30, 19, bad), "bomb": ("png", 60_001, 1_000, bad), "jpeg": ("jpeg", 640, 480, None), "many": ("jpeg", 25, 31, None), "endless": ("jpeg", None, None, bad), "cut": ("jpeg", None, None, bad),
        "gif": ("gif", 300, 200, None), "bmp": ("bmp", 70, 80, None), "none": (None, None, None, "EMPTY_UPLOAD"), "null": (None, None, None, "EMPTY_UPLOAD"), "large": (None, None, None, "IMAGE_TOO_LARGE"), "text": (None, None, None, bad),
    }


def test_batches_that_break_constraints_are_not_committed(spark, tmp_path):
    from tallymark.sources.constraints import ConstraintError

    good = spark.createDataFrame([(1, "compliant", None), (2, None, "low")], "scan_id long, overall_status string, risk_level string")
    bad = spark.createDataFrame([(3, "fine", "low"), (4, "failed", "huge")], good.schema)
    assert sinks.append_batch({"compliance_results": good}, str(tmp_path), "a")
    with pytest.raises(ConstraintError, match="overall_status:check .1 rows"):
        sinks.append_batch({"compliance_results": bad}, str(tmp_path), "b")
    assert sinks.committed(spark, str(tmp_path), "compliance_results").count() == 2


def test_a_run_tells_its_stages(spark, sf, products, tmp_path):
    from tallymark.plans.runs import run

    s, folder = scans(spark, ("MRP Rs. 30", "8901719123870", "success"), ("blank", None, "success")), str(tmp_path)
    results, stages = run(s, products, view(spark, sf, "rules"), "one", folder)
    assert [(r.stage, r.status, r.rows) for r in stages.table().collect()] == [("field_extraction", "success", 2), ("product_matching", "success", 2), ("compliance_engine", "success", 2), ("persist_results", "success", None)]
    assert {r.scan_id: r.reference_found for r in results.collect()} == {0: True, 1: False}
    assert sinks.committed(spark, folder, "scan_records").count() == 2 and sinks.committed(spark, f"{folder}/metrics", "stage_metrics").where("duration_ms >= 0").count() == 4
    broken = products.withColumn("mrp", F.raise_error(F.lit("no catalogue")).cast("double"))
    results, stages = run(s, broken, view(spark, sf, "rules"), "two", folder)
    assert {r.scan_id: r.reference_found for r in results.collect()} == {0: False, 1: False}
    lost = stages.table().where("status = 'failed'").collect()
    assert [(r.stage, r.error_code) for r in lost] == [("product_matching", "REFERENCE_LOOKUP_ERROR")] and "no catalogue" in lost[0].error


def test_the_seed_file_stands_in_for_a_catalogue_that_cannot_be_read(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps([{"reference_product_id": "p", "brand": "b"}]))
    spark.createDataFrame([("q",)], "reference_product_id string").createOrReplaceTempView("tm_catalogue")
    assert readers.products(spark, "tm_catalogue", str(seed)).first().reference_product_id == "q"
    spark.createDataFrame([("q",)], "reference_product_id string").select(F.raise_error(F.col("reference_product_id")).alias("reference_product_id")).createOrReplaceTempView("tm_catalogue")
    for name in ("tm_catalogue", "no_such_table", None):
        assert readers.products(spark, name, str(seed)).first().reference_product_id == "p"


def test_layouts_need_no_shuffle_and_read_the_newest_days(spark, sf):
    from tallymark.plans.queries import QUERIES
    from tallymark.sources import layout

    plan = QUERIES["header_details_bucketed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    rows = spark.range(1000).select(F.col("id").alias("scan_id"), (F.lit(datetime.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id").cast("int") % 100)).alias("created_at"))
    path = layout.by_day(rows, "days")
    part = layout.latest(spark, path, 35)
    assert part.count() == 40 and "PartitionFilters: [day" in part._jdf.queryExecution().executedPlan().toString() and layout.latest(spark, path, 5000).count() == 1000
    assert part.agg(F.min("created_at")).first()[0] == datetime.datetime(2024, 4, 6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**12 - 1), min_size=1, max_size=8))
def test_check_digits_close(spark, bodies):
    from tallymark.functions.numbers import check_digit, is_article_number

    rows = spark.createDataFrame([(f"{b:012d}",) for b in bodies], "b string")
    full = rows.select(F.concat("b", check_digit(F.col("b")).cast("string")).alias("c"))
    assert full.where(is_article_number(F.col("c"))).count() == len(bodies)


def test_known_rules_are_built_into_the_plan(spark, sf, monkeypatch):
    """Checks of few rules are constants that cases choose from; they are those of the array that more rules go by."""
    seen = stored(pipeline.evidence(view(spark, sf, "label_scans"), view(spark, sf, "products"), fuzzy=False), "seen")
    odd = "SELECT 90 AS rule_pos, 'Y-1' AS rule_code, 'Any' AS rule_name, 'any' AS field_name, 'any_field_present' AS operator, ' use_by , mrp' AS expected_value, CAST(NULL AS string) AS severity, CAST(NULL AS string) AS description, '1' AS version"
    odd += " UNION ALL SELECT 91, 'Y-2', 'No operator', NULL, NULL, NULL, 'low', NULL, NULL UNION ALL SELECT 92, 'Y-3', 'Maker', 'manufacturer', 'reference_field_match', 'manufacturer', 'low', NULL, '2'"
    columns = [*rules.RULE_FIELDS, "version"]
    table = view(spark, sf, "rules").select(*columns).unionByName(spark.sql(odd))
    plan = rules.judged(seen, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "tm_rules" not in plan and "lambda" not in plan
    one = {tuple(map(str, r)) for r in rules.folded(rules.judged(seen, table)).collect()}
    monkeypatch.setattr(rules, "UNROLLED", 0)
    assert one == {tuple(map(str, r)) for r in rules.folded(rules.judged(seen, table)).collect()}


def test_blanks_of_any_kind_part_the_words_of_labels_and_lists(spark):
    rows = spark.createDataFrame([(1, "Net  Wt: 370 g\nUse　by 08/10/24\nMfd. by Acme Foods Pvt Ltd")], "scan_id long, text string")
    row = extract.raw_fields(rows, F.to_date(F.lit("2024-06-30"))).select("net_quantity_raw", "use_by_raw", "maker_raw").first()
    assert tuple(row) == ("370 g", "08/10/24", "Acme Foods Pvt Ltd")
    assert spark.range(1).select(comma_list(F.lit("a0, b1 ,, c2")).alias("a")).first().a == ["a0", "b1", "c2"]


def test_few_names_are_searched_as_the_index_is_probed(spark, sf):
    scans = match.with_brand(view(spark, sf, "label_scans").select("scan_id", "text"), view(spark, sf, "products"))
    found = lambda few: {tuple(r) for r in match.by_name(scans, view(spark, sf, "products"), few=few).collect()}
    assert found(500) == found(0) and found(0)


def test_comparisons_wait_for_a_reference(spark, sf):
    seen = pipeline.evidence(view(spark, sf, "label_scans"), view(spark, sf, "products"), fuzzy=False)
    assert seen.where("reference_found <> (size(comparisons) = 6)").isEmpty()


def test_tables_over_the_bound_are_not_broadcast_for_their_file_size(spark, sf, monkeypatch):
    monkeypatch.setattr(match, "BROADCAST_ROWS", 10)
    found = match.by_barcode(view(spark, sf, "label_scans"), view(spark, sf, "products"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_result_tables_are_joined_without_a_broadcast(spark, sf):
    from tallymark.plans.queries import QUERIES

    assert "BroadcastHashJoin" not in QUERIES["result_tables"](spark, sf)._jdf.queryExecution().executedPlan().toString()
