"""The rule table: which rules hold on a day, one check for each scan and rule, and the folds of a scan's checks.

Rules are few, as their table is curated: after a check of their number they are built into the plan, or broadcast as one
array. A check is one CASE over the operator; a scan's checks are made and folded within its row.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import comma_list, contact_noise, once, same_company

PASS, FAIL, REVIEW, NOT_APPLICABLE = "PASS", "FAIL", "REVIEW_REQUIRED", "NOT_APPLICABLE"
#: Fields that differ by batch, and the ones that count as declarations.
BATCH_FIELDS = ("manufacturing_date", "packing_date", "use_by", "best_before")
COUNTED = ("mrp", "net_quantity", "manufacturer_address", "manufacturing_date", "use_by", "best_before", "consumer_care_contact")
TAMPERING_LIMIT = 0.55
MAX_RULES = 10_000
ENGINE_VERSION = "1.0"


def active(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules that are switched on and valid on the day as_of; both ends count. No flag means on."""
    on = F.coalesce(F.col("is_active"), F.lit(True))
    return rules.where(on & (F.col("effective_from").isNull() | (F.col("effective_from") <= as_of)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= as_of)))


def rules_version(rules: DataFrame) -> DataFrame:
    """One row: the distinct versions in order, or 'unversioned'."""
    joined = F.array_join(F.array_sort(F.collect_set(F.nullif("version", F.lit("")))), ",")
    return rules.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit("unversioned")).alias("rules_version"))


def joined_versions(versions: Iterable[str | None]) -> str:
    """What rules_version gives, of versions at hand."""
    return ",".join(sorted({v for v in versions if v})) or "unversioned"


def declaration_count(presence: Column, noisy_address: Column) -> Column:
    here = lambda n: F.coalesce(F.try_element_at(presence, F.lit(n)), F.lit(False)) & (~noisy_address if n == "manufacturer_address" else F.lit(True))
    return sum((F.when(here(n), 1).otherwise(0) for n in COUNTED[1:]), F.when(here(COUNTED[0]), 1).otherwise(0))


RULE_FIELDS = ("rule_pos", "rule_code", "rule_name", "field_name", "operator", "expected_value", "severity", "description")
#: Up to so many rules, each rule's check is an expression of its own.
UNROLLED = 64


def check(rule: Column | dict[str, Column], known: Row | None = None) -> Column:
    """The check of one rule over a row of evidence: struct<rule_pos, rule_code, field_name, status, message, severity, missing>.

    Of a rule that is known while the plan is made, only the cases of its own operator are built, and what they give are
    constants; noisy is then looked up in tm_noisy.
    """
    present = lambda n: F.coalesce(F.try_element_at("presence", n), F.lit(False))
    noisy = contact_noise(F.col("address_value"), F.col("address_raw")) if known is None else F.col("tm_noisy")
    op, expected, field = rule["operator"], rule["expected_value"], rule["field_name"]
    ok = F.concat(F.lit("OK: "), rule["rule_name"], F.lit("."))
    about = F.coalesce(rule["description"], rule["rule_name"])
    issue, review = F.concat(F.lit("Issue: "), about), F.concat(F.lit("Review required: "), about)

    here = present(field)
    bad_address = here & (field == "manufacturer_address") & noisy
    if known is None:
        some = F.exists(comma_list(expected), lambda n: present(n))
    else:
        some = reduce(or_, (present(F.lit(n)) for n in (x.strip(" ") for x in (known["expected_value"] or "").split(",")) if n != ""), F.lit(False))
    enough = declaration_count(F.col("presence"), noisy) >= F.coalesce(expected.try_cast("int"), F.lit(0))
    score = F.when(F.col("tampering_status") == "success", F.col("tampering_score"))
    below = score < F.coalesce(expected.try_cast("double"), F.lit(TAMPERING_LIMIT))
    entry = F.try_element_at("comparisons", expected)
    company = (expected == "manufacturer") & same_company(entry["live"], entry["reference"])
    # The messages of the checks.
    cases = [
        ("field_present", bad_address, REVIEW, F.lit("Review required: OCR extracted contact-section text instead of a verified manufacturer/address declaration.")),
        ("field_present", here, PASS, ok),
        ("field_present", None, FAIL, issue),
        ("any_field_present", some, PASS, ok),
        ("any_field_present", None, FAIL, issue),
        ("min_declarations", enough, PASS, ok),
        ("min_declarations", None, FAIL, issue),
        ("tampering_score_below", score.isNull(), NOT_APPLICABLE, F.lit("Tampering evidence unavailable for this scan.")),
        ("tampering_score_below", below, PASS, ok),
        ("tampering_score_below", None, REVIEW, review),
        ("reference_field_match", ~F.col("reference_found"), NOT_APPLICABLE, F.lit("No reference product available for comparison.")),
        ("reference_field_match", expected.isin(*BATCH_FIELDS), NOT_APPLICABLE, F.concat(F.lit("Reference comparison skipped for batch-specific field '"), expected, F.lit("'. The value may legitimately differ between production batches."))),
        ("reference_field_match", entry.isNull() | (entry["status"] == "NOT_AVAILABLE"), NOT_APPLICABLE, F.lit("Reference value not available for this field.")),
        ("reference_field_match", entry["status"] == "MATCH", PASS, ok),
        ("reference_field_match", company, PASS, F.lit("OK: Manufacturer matches the reference after text normalization.")),
        ("reference_field_match", None, REVIEW, review),
    ]

    def given(status: str, message: Column, name: str | None = None) -> Column:
        missing = name == "field_present" and status in (FAIL, REVIEW) or name == "any_field_present" and status == FAIL
        return F.struct(rule["rule_pos"].cast("long").alias("rule_pos"), rule["rule_code"].alias("rule_code"), field.alias("field_name"), F.lit(status).alias("status"), message.alias("message"), F.coalesce(rule["severity"], F.lit("medium")).alias("severity"), F.lit(missing).alias("missing"))

    result = given(NOT_APPLICABLE, ok)
    for name, cond, status, message in reversed(cases):
        if known is None:
            cond = (op == name) if cond is None else (op == name) & cond
        elif known["operator"] != name:
            continue
        result = given(status, message, name) if cond is None else F.when(cond, given(status, message, name)).otherwise(result)
    unread = given(NOT_APPLICABLE, F.lit("Could not be evaluated: text extraction (OCR) was unavailable for this scan."))
    return F.when((F.col("ocr_status") != "success") & (op != "tampering_score_below"), unread).otherwise(result)


def judged(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """evidence with tm_checks, the checks of all rules in the order of rule_pos, and rules_version.

    evidence: scan_id, ocr_status, presence (map<field, found>), address_value, address_raw, tampering_status,
    tampering_score, reference_found, comparisons (map<field, struct<live, reference, match, status>>).

    Rules are curated, so they are few: up to UNROLLED, each is an expression of constants. More go to all scans as one row
    with one array, and each scan is judged within its own row, without a shuffle. Beyond MAX_RULES, a count decides, scans
    and rules are joined and gathered again.
    """
    few = rules.select(*RULE_FIELDS, "version").limit(MAX_RULES + 1).collect()
    if 0 < len(few) <= min(UNROLLED, MAX_RULES):
        fixed = lambda r: {c: F.lit(r[c]).cast(rules.schema[c].dataType) for c in RULE_FIELDS}
        version = evidence.sparkSession.createDataFrame([(joined_versions(r["version"] for r in few),)], "rules_version string")
        noted = once(evidence.crossJoin(F.broadcast(version)), tm_noisy=contact_noise(F.col("address_value"), F.col("address_raw")))
        made = F.array(*(check(fixed(r), r) for r in sorted(few, key=lambda r: r["rule_pos"])))
        return once(noted, tm_checks=made).drop("tm_noisy")
    if len(few) <= MAX_RULES:
        table = [tuple(r[c] for c in RULE_FIELDS) for r in sorted(few, key=lambda r: r["rule_pos"])]
        kinds = ", ".join(f"{c}: {rules.schema[c].dataType.simpleString()}" for c in RULE_FIELDS)
        compiled = evidence.sparkSession.createDataFrame([(table, joined_versions(r["version"] for r in few))], f"tm_rules array<struct<{kinds}>>, rules_version string")
        return once(evidence.crossJoin(F.broadcast(compiled)), tm_checks=F.transform("tm_rules", lambda r: check(r))).drop("tm_rules")  # one row
    each = evidence.crossJoin(rules.select(F.struct(*RULE_FIELDS).alias("tm_rule")))  # the result has a check for each scan and rule
    results = each.select("scan_id", check(F.col("tm_rule")).alias("tm_check")).groupBy("scan_id").agg(F.array_sort(F.collect_list("tm_check")).alias("tm_checks"))
    return evidence.join(results, "scan_id").crossJoin(F.broadcast(rules_version(rules)))  # one row


def checks(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each scan and rule: scan_id, rule_pos, rule_code, field_name, status, message, severity, missing."""
    return judged(evidence, rules).select("scan_id", F.inline("tm_checks"))


RISKS = ("NONE", "LOW", "MEDIUM", "HIGH")


def folded(seen: DataFrame) -> DataFrame:
    """Judged evidence with overall_status, risk_level, matched_fields, mismatched_fields, missing_fields, rule_results,
    explanation, warnings and engine_version, instead of tm_checks and comparisons. All is done within a scan's row."""
    ocr, found = F.col("ocr_status") == "success", F.col("tm_checks")
    failed = lambda x: x["status"] == FAIL
    rank = lambda x: F.when(x["severity"] == "high", 3).when(x["severity"] == "medium", 2).otherwise(1)
    worst = F.aggregate(found, F.lit(0), lambda a, x: F.when(x["status"].isin(FAIL, REVIEW), F.greatest(a, rank(x))).otherwise(a))
    # a struct: the flags of a scan's checks, taken once
    flags = F.struct(
        F.exists(found, lambda x: failed(x) & (x["severity"] == "high")).alias("high"), worst.alias("worst"),
        F.exists(found, lambda x: failed(x) & (x["rule_code"] == "LM-006")).alias("near_zero"),
    )
    company = lambda k, v: (k == "manufacturer") & (v["status"] == "MISMATCH") & same_company(v["live"], v["reference"])
    compared = F.map_filter("comparisons", lambda k, v: ~k.isin(*BATCH_FIELDS) & v["status"].isin("MATCH", "MISMATCH"))
    as_match = lambda v: v.withField("match", F.lit(True)).withField("status", F.lit("MATCH"))
    settled = F.transform_values(compared, lambda k, v: F.when(company(k, v), as_match(v)).otherwise(v))
    both = once(seen, tm_flags=flags, tm_settled=settled)
    high, open_ = F.col("tm_flags.high"), F.col("tm_flags.worst") > 0
    status = F.when(~ocr, REVIEW).when(high, "NON_COMPLIANT").when(open_, REVIEW).otherwise(PASS)
    risk = F.when(~ocr, F.when(high, "HIGH").otherwise("MEDIUM")).otherwise(F.element_at(F.array(*map(F.lit, RISKS)), F.col("tm_flags.worst") + 1))
    both = once(
        both, overall_status=status, risk_level=risk,
        matched_fields=F.map_filter("tm_settled", lambda k, v: v["status"] == "MATCH"), mismatched_fields=F.map_filter("tm_settled", lambda k, v: v["status"] == "MISMATCH"),
        missing_fields=F.transform(F.filter(found, lambda x: x["missing"]), lambda x: x["field_name"]), rule_results=F.transform(found, lambda x: x.dropFields("missing")),
        # The warnings of a verdict.
        warnings=F.array_compact(F.array(
            F.when(~ocr, F.lit("Declaration checks could not be run because OCR was unavailable - rescan or review manually."))
            .when(F.col("tm_flags.near_zero"), F.lit("Near-zero declarations found - likely a completely unlabeled or non-compliant product."))
        )),
    )
    return both.withColumns({"explanation": explanation(ocr), "engine_version": F.lit(ENGINE_VERSION)}).drop("tm_checks", "tm_flags", "tm_settled", "comparisons")


def applicable(results: Column) -> Column:
    """The results of rules that could be evaluated."""
    return F.filter(results, lambda x: x["status"] != NOT_APPLICABLE)


def explanation(ocr: Column) -> Column:
    """The sentences on a verdict: names of fields are in the order of checks and comparisons."""
    n, m = F.size("missing_fields"), F.size("mismatched_fields")
    listed = lambda count, text, names: F.when(count > 0, F.concat(count.cast("string"), F.lit(text), F.array_join(names, ", "), F.lit(".")))
    # The sentences.
    gaps = listed(n, " mandatory declaration(s) missing: ", F.col("missing_fields"))
    differ = listed(m, " field(s) do not match the reference product: ", F.map_keys("mismatched_fields"))
    clear = F.when((n == 0) & (m == 0), F.lit("All applicable declarations were found and passed the configured consistency checks."))
    risk = F.concat(F.lit("Overall risk level: "), F.col("risk_level"), F.lit("."))
    unread = F.lit("Label text could not be read (OCR unavailable) - declaration checks were skipped for this scan.")
    return F.when(~ocr, unread).otherwise(F.concat_ws(" ", gaps, differ, clear, risk))


def stored_status(c: Column) -> Column:
    """The status as tables keep it; unknown ones are for review."""
    s = F.upper(F.trim(c))
    return F.when(s.isin("PASS", "COMPLIANT"), "compliant").when(s.isin("NON_COMPLIANT", "REVIEW_REQUIRED", "PROCESSING", "FAILED"), F.lower(s)).otherwise("review_required")


def stored_risk(c: Column) -> Column:
    r = F.upper(F.trim(c))
    return F.when(r.isin("LOW", "MEDIUM", "HIGH"), F.lower(r))
