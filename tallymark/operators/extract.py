"""Declared fields of label texts. Columns over an array of cleaned lines; look-ahead is array access, so no shuffle."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import LEGAL_FORM, SPACE, clean, for_matching, found, is_major, let, lines, once

#: Fixed values of the label patterns.
MRP_LINE = r"(?i)\b(?:mrp|m\.r\.p)\b\s*(?:[:=\-x]\s*)?(?:(₹|rs\.?|inr)\s*)?(\d+(?:[.,]\s*\d+)?)\b"
MRP_LABEL = r"^(?i)(?:mrp|m\.r\.p)[.:=\-]?$"
MRP_VALUE = r"^(?i)(?:(₹|rs\.?|inr)\s*)?(\d+(?:[.,]\d+)?)(?:\s+.*)?$"
UNIT = r"(?:\s*(?:kg|gms|gm|g|ml|litre|liter|l))?"
QUANTITY = rf"\d+(?:\.\d+)?{UNIT}(?:\s*\+\s*\d+(?:\.\d+)?{UNIT}\s*extra)?(?:\s*=\s*\d+(?:\.\d+)?{UNIT})?"
NET_LABEL = r"\bnet\s*(?:wt|weight|we|qty|quantity|contents)\b"
PACKED_LABEL = r"(?:\bpkd\b|\bmfd\b|\bmfg\b|\bmanufactured\b|\bpacked\b|\bpackaging\b)"
USE_BY_LABEL = r"\buse\s*by\b"
BEST_BEFORE_LABEL = r"\bbest\s*before\b"
CARE = r"(?i)(?:\bphone\s*no\.?|\bconsumer\s*care\b|\bcustomer\s*care\b|\btoll\s*free\b)[.\s:]*([\d\s()+\-]{8,25}|[\w.\-+@]{5,60})"
BATCH = r"(?i)\b(?:batch|lot)\b(?:\s*(?:no|number|num))?[:\s.\-]*([\w\-/]{2,30})"
ORIGIN = r"(?i)\bcountry\s*of\s*origin\b[:\s]*(\w[\w \t]{2,39})"
MADE_BY = r"^(?i)(?:mfd\.?\s*by|manufactured\s*by|packed\s*by|marketed\s*by)[ \t:.\-]*(.*?)[ \t]*$"
MADE_AT = r"^(?i)(?:[A-Z0-9\-]{1,4}\s*[-:]\s*)?at\s*:\s*(.*)$"
MADE_ALONE, BY_ALONE = r"^(?i)(?:mfd\.?|manufactured|packed|marketed)$", r"^(?i)by[:.\-]*$"

#: Fixed values of the company and address tests.
COMPANY_FORM = r"\b(?:PVT\.?\s*LTD|PRIVATE\s+LIMITED|LIMITED|LTD\.?)\b"
MADE_BY_WORDS = ("manufacturer", "manufactured by", "mfd by")
COMPANY_MARKERS = (" PVT", " PRIVATE", " LTD", " LIMITED", " LLP", " INC", " CORPORATION", " INDUSTRIES", " ENTERPRISES", " ENTERPRISE", " FOODS", " FOOD", " COMPANY", " CO.")
COMPANY_CONTACT = r"\b(?:QUERIES|CONTACT|PHONE|EMAIL|E-MAIL|HELPLINE|CONSUMER CARE|CUSTOMER CARE)\b"
NOT_COMPANY = ("queries", "contact", "consumer care", "customer care", "phone no", "e-mail", "email", "visit us", "for sale", "net weight", "nutrition", "mrp", "use by", "best before")
LEGAL_WORDS = ("pvt", "ltd", "limited", "private", "llp", "inc", "inc.")
ADDRESS_WORDS = ("road", "rd", "crossing", "mumbai", "pune", "delhi", "bengaluru", "bangalore", "kolkata", "chennai", "maharashtra", "mh-", "pin", "india", "east", "west", "nagar", "industrial", "estate", "district", "dist.", "taluk", "phase", "plot", "sector")
ADDRESS_END = ("mumbai", "maharashtra", "punjab", "karnataka")
SKIP_STARTS = ("from ", "visit us", "manufactured for", "for sale", "storage conditions", "consumer care", "customer care", "phone no", "email", "ingredients", "nutrition information")
TRADE_WORDS = ("biscuits", "foods", "food", "products", "industries", "nutritionals", "specialities")
#: Words one of which is in every text that has a label of each kind, in small letters; plain searches before patterns.
WORDS = {
    "mrp_raw": ("mrp", "m.r.p"), "net_quantity_raw": ("net",), "packing_date_raw": ("pkd", "mfd", "mfg", "manufactured", "packed", "packaging"), "use_by_raw": ("use",), "best_before_raw": ("best",),
    "care_raw": ("phone", "consumer", "customer", "toll"), "batch_raw": ("batch", "lot"), "origin_raw": ("country",),
}
PRICE_SIGNS = r"(?i)mrp|m\.r\.p"
DATE_SIGNS = {PACKED_LABEL: r"(?i)pkd|mf[dg]|manufac|pack", USE_BY_LABEL: r"(?i)use", BEST_BEFORE_LABEL: r"(?i)best"}
#: Signs that a text (FORM_SIGNS: in capitals) with a declaration of each kind holds; others hold some of them as well.
FORM_SIGNS = "LTD|LIMITED|PVT"
MADE_SIGNS, AT_SIGNS = rf"(?i)(?:mfd\.?|manufactured|packed|marketed){SPACE}*by", rf"(?i)at{SPACE}*:"
#: One brand's name that recognition runs together; a row of data, so that others can be added.
REPAIRS = (("PARLE", ("BISCUTS", "BISCUITS"), r"PVT\.?\s*LTD", "Parle Biscuits Pvt Ltd"),)
#: Points of a line as a company name.
POINTS = {
    "private limited, short": 8,
    "private limited": 8,
    "limited": 4,
    "trade word": 3,
    "made by": 7,
    "address": 2,
    "each digit": -10,
    "brackets": -8,
    "three words": 3,
}
ENOUGH = 4


def at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def numbered(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(x.alias("line"), i.alias("i")))


# --- price and quantity


def price_candidates(a: Column) -> Column:
    """array<struct<value, currency>> of prices beside a label, or, where there are none, on the line after a bare label."""

    def hit(line: Column, pattern: str) -> Column:
        value = F.regexp_replace(F.regexp_extract(line, pattern, 2), r"([.,])\s+", "$1")
        return F.struct(value.alias("value"), (F.regexp_extract(line, pattern, 1) != "").alias("currency"))

    usable = lambda c: (c["value"] != "") & (F.length(F.regexp_replace(c["value"], r"\D", "")) <= 6)
    beside = F.filter(F.transform(F.filter(a, lambda x: x.rlike(PRICE_SIGNS)), lambda x: hit(x, MRP_LINE)), usable)
    below = F.filter(numbered(a), lambda x: x["line"].rlike(MRP_LABEL) & ~F.coalesce(is_major(at(a, x["i"] + 1)), F.lit(True)))
    below = F.filter(F.transform(below, lambda x: hit(at(a, x["i"] + 1), MRP_VALUE)), usable)
    return let(beside, lambda b: F.when(F.size(b) > 0, b).otherwise(below))


def price(a: Column) -> Column:
    """The first candidate with a currency sign, else the first."""
    return let(price_candidates(a), lambda c: F.coalesce(first(F.filter(c, lambda x: x["currency"])), first(c))["value"])


def quantity(a: Column) -> Column:
    named = F.filter(a, lambda x: x.rlike("(?i)net"))
    beside = first(F.filter(F.transform(named, lambda x: found(x, rf"(?i){NET_LABEL}[:\s.]*({QUANTITY})")), lambda v: v.isNotNull()))
    labels = F.filter(numbered(a), lambda x: x["line"].rlike("(?i)net") & x["line"].rlike(f"(?i){NET_LABEL}"))

    def near(x: Column) -> Column:
        tail = found(x["line"], rf"(?i){NET_LABEL}[\s:.\-]*({QUANTITY})$")
        below = at(a, x["i"] + 1)
        return F.coalesce(tail, F.when(~is_major(below) & below.rlike(f"^(?i){QUANTITY}$"), below))

    return F.coalesce(beside, first(F.filter(F.transform(labels, near), lambda v: v.isNotNull())))


# --- dates


def date_after(a: Column, label: str) -> Column:
    """The first date behind a label: on its line, the next (whatever it is) or the one after unless a declaration
    starts there; labels without any date are passed over."""
    inline = lambda line: found(line, f"({dates.DATE})")

    def near(x: Column) -> Column:
        one, two = at(a, x["i"] + 1), at(a, x["i"] + 2)
        return F.coalesce(inline(F.regexp_extract(x["line"], f"(?i){label}(.*)$", 1)), inline(one), F.when(~is_major(two), inline(two)))

    labels = F.filter(numbered(a), lambda x: x["line"].rlike(DATE_SIGNS.get(label, "")) & x["line"].rlike(f"(?i){label}"))
    return first(F.filter(F.transform(labels, near), lambda v: v.isNotNull()))


def packing_date(a: Column, as_of: Column) -> Column:
    """As date_after; an impossible or future date there means none at all."""
    return let(date_after(a, PACKED_LABEL), lambda d: F.when(dates.plausible_packing_date(d, as_of), d))


# --- company and address


def repaired(c: Column) -> Column:
    return let(clean(c), lambda value: let(F.upper(value), lambda upper: respelled(value, upper)))


def respelled(value: Column, upper: Column) -> Column:
    for name, variants, form, right in REPAIRS:
        spelled = F.contains(upper, F.lit(variants[0]))
        for v in variants[1:]:
            spelled = spelled | F.contains(upper, F.lit(v))
        value = F.when(F.contains(upper, F.lit(name)) & spelled & upper.rlike(form), F.lit(right)).otherwise(value)
    return value


def any_in(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether c contains any of the parts; one pattern, which keeps plans small."""
    return c.rlike("|".join(map(re.escape, parts)))


def is_company(c: Column) -> Column:
    return let(clean(F.coalesce(c, F.lit(""))), is_clean_company)


def is_clean_company(value: Column) -> Column:
    """is_company of a text without runs of white space."""
    return let(F.upper(value), lambda upper: let(F.lower(value), lambda low: names_company(value, upper, low)))


def names_company(value: Column, upper: Column, low: Column) -> Column:
    words = F.filter(F.split(value, " "), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,()]+|[.,()]+$", ""))
    telling = F.exists(bare, lambda w: ~w.isin(*LEGAL_WORDS) & (F.length(w) >= 3))
    return (
        (F.length(value) >= 8)
        & any_in(F.concat(F.lit(" "), upper, F.lit(" ")), COMPANY_MARKERS)
        & ~upper.rlike(COMPANY_CONTACT)
        & ~any_in(low, NOT_COMPANY)
        & value.rlike("[A-Za-z]{3}")
        & (F.size(words) >= 2)
        & ~F.regexp_replace(value, r"(?i)\s+(?:wt\s*[-:]?\s*)?\d{6}\s*$", "").rlike(r"\d")
        & ~value.rlike(r"^[(\[{]")
        & (F.length(F.regexp_replace(value, r"[A-Za-z0-9\s&.,()\-]", "")) < 2)
        & telling
    )


def address_evidence(c: Column) -> Column:
    return let(clean(F.coalesce(c, F.lit(""))), shows_address)


def shows_address(value: Column) -> Column:
    """address_evidence of a text without runs of white space, the cheapest test first."""
    return F.contains(value, F.lit(",")) | value.rlike(r"\b\d{6}\b") | any_in(F.lower(value), ADDRESS_WORDS)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(clean(c), r"^[\s:;,.\-]+|[\s:;,.\-]+$", "")


def declared(c: Column, end: Column) -> Column:
    """struct<name, address, end> of a company declaration, null where it names no company."""
    made = lambda full, name: F.when(is_clean_company(name), F.struct(name.alias("name"), F.when(shows_address(full), full).alias("address"), end.cast("int").alias("end")))
    return let(trimmed(c), lambda full: let(repaired(full), lambda name: made(full, name)))


def has_form(c: Column) -> Column:
    return c.rlike(LEGAL_FORM)


def joined_lines(a: Column, start: Column) -> Column:
    """struct<text, last> of up to three lines from start on, until a legal form is complete or a declaration starts."""
    zero = F.struct(F.lit("").alias("text"), (start - 1).cast("int").alias("last"), F.lit(False).alias("stop"))

    def step(acc: Column, k: Column) -> Column:
        ends = lambda line: acc["stop"] | ((k > 0) & is_major(line)) | at(a, start + k).isNull()
        more = lambda line, text: F.struct(text.alias("text"), F.when(line == "", acc["last"]).otherwise((start + k).cast("int")).alias("last"), has_form(text).alias("stop"))
        stay = F.struct(acc["text"].alias("text"), acc["last"].alias("last"), F.lit(True).alias("stop"))
        grow = lambda line: let(clean(F.concat_ws(" ", acc["text"], line)), lambda text: F.when(ends(line), stay).otherwise(more(line, text)))
        return let(trimmed(F.coalesce(at(a, start + k), F.lit(""))), grow)

    return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), zero, step)


def maker_explicit(a: Column) -> Column:
    """Phase 1: lines that start with a "made by" label."""
    label = MADE_BY

    def near(x: Column) -> Column:
        below = at(a, x["i"] + 1)

        def of(rest: Column) -> Column:
            goes_on = ~has_form(rest) & F.coalesce((below != "") & ~is_major(below), F.lit(False))
            part = lambda text, end: F.struct(text.alias("text"), end.cast("int").alias("last"))
            more = F.when(goes_on, part(F.concat_ws(" ", rest, below), x["i"] + 1)).otherwise(part(rest, x["i"]))
            lone = let(joined_lines(a, x["i"] + 1), lambda j: part(j["text"], j["last"]))
            return let(F.when(rest == "", lone).otherwise(more), lambda d: declared(d["text"], d["last"]))

        return let(trimmed(F.regexp_extract(x["line"], label, 1)), of)

    hits = F.transform(F.filter(numbered(a), lambda x: x["line"].rlike(label)), near)
    return first(F.filter(hits, lambda d: d.isNotNull()))


def maker_at(a: Column) -> Column:
    """Phase 2: "at:" lines; at least one following line belongs to the declaration."""
    label = MADE_AT

    def near(x: Column) -> Column:
        start, one, two = trimmed(F.regexp_extract(x["line"], label, 1)), at(a, x["i"] + 1), at(a, x["i"] + 2)
        stop = F.coalesce(is_major(one), F.lit(True))
        with_one = F.when(stop, start).otherwise(clean(F.concat_ws(" ", start, one)))
        add_two = lambda t: ~stop & ~has_form(t) & F.coalesce(~is_major(two), F.lit(False))
        return declared(let(with_one, lambda t: F.when(add_two(t), F.concat_ws(" ", t, two)).otherwise(t)), x["i"])

    hits = F.transform(F.filter(numbered(a), lambda x: x["line"].rlike(label)), near)
    return first(F.filter(hits, lambda d: d.isNotNull()))


def maker_split(a: Column) -> Column:
    """Phase 3: the label's words and the company on three lines."""
    label = F.filter(numbered(a), lambda x: x["line"].rlike(MADE_ALONE) & F.coalesce(at(a, x["i"] + 1).rlike(BY_ALONE), F.lit(False)) & at(a, x["i"] + 2).isNotNull())
    hits = F.transform(label, lambda x: declared(at(a, x["i"] + 2), x["i"] + 2))
    return first(F.filter(hits, lambda d: d.isNotNull()))


def maker_score(line: Column) -> Column:
    """Points of a line as a company name, null where it cannot be one."""
    return let(repaired(line), lambda name: let(F.lower(line), lambda low: let(F.upper(line), lambda upper: name_score(line, name, low, upper))))


def name_score(line: Column, name: Column, low: Column, upper: Column) -> Column:
    skip = low.rlike(f"^(?:{'|'.join(map(re.escape, SKIP_STARTS))})")
    head = F.regexp_replace(F.regexp_extract(line, r"^(\S+)", 1), r"^[.,()]+|[.,()]+$", "")
    form = upper.rlike(COMPANY_FORM)
    run_on = F.lit(False)
    for brand, variants, _, _ in REPAIRS:
        run_on = run_on | (F.contains(upper, F.lit(brand)) & F.contains(upper, F.lit("PVT")) & any_in(upper, variants))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    flag = lambda cond, points: F.when(cond, POINTS[points]).otherwise(0)
    points = flag(name.rlike(r"(?i)\bPVT\.?\s*LTD\b"), "private limited, short") + flag(name.rlike(r"(?i)PRIVATE\s+LIMITED"), "private limited") + flag(name.rlike(r"(?i)\bLIMITED\b"), "limited")
    for w in TRADE_WORDS:
        points = points + flag(F.contains(F.lower(name), F.lit(w)), "trade word")
    points = points + flag(any_in(low, MADE_BY_WORDS), "made by") + flag(shows_address(name), "address")
    points = points + POINTS["each digit"] * count(name, r"\d") + flag(name.rlike(r"[()\[\]{}]"), "brackets") + flag(count(name, "[A-Za-z]{3,}") >= 3, "three words")
    return F.when(~skip & (F.length(head) >= 2) & (form | run_on) & is_clean_company(name), points)


def maker_scored(a: Column) -> Column:
    """Phase 4: the line with most points, the first of equals, if it has four or more."""
    may = F.filter(numbered(a), lambda x: F.upper(x["line"]).rlike(FORM_SIGNS))
    rated = F.transform(may, lambda x: F.struct((-maker_score(x["line"])).alias("rank"), x["i"].alias("i"), x["line"].alias("line")))
    best = F.array_min(F.filter(rated, lambda x: x["rank"] <= -ENOUGH))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(repaired(b["line"]).alias("name"), F.lit(None).cast("string").alias("address"), b["i"].cast("int").alias("end"))))


def maker_address(a: Column, maker: Column) -> Column:
    """Phases 5 and 6: the declaration itself where it is an address, its next lines, or any line with evidence."""
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("stop"))

    def step(acc: Column, k: Column) -> Column:
        line = at(a, maker["end"] + k)
        stop = acc["stop"] | line.isNull() | F.coalesce(is_major(line), F.lit(False))
        last = F.coalesce(line.rlike(r"\b\d{6}\b") | any_in(F.lower(line), ADDRESS_END), F.lit(False))
        kept = lambda evidence: F.struct(F.when(evidence, clean(F.concat_ws(" ", acc["text"], line))).otherwise(acc["text"]).alias("text"), (stop | (evidence & last)).alias("stop"))
        return let(~stop & shows_address(line), kept)

    near = F.nullif(F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), zero, step, lambda acc: acc["text"]), F.lit(""))
    unfit = lambda x: F.lower(x).rlike(r"^(?:from |visit us|manufactured for|for sale)")
    anywhere = first(F.filter(a, lambda x: (F.length(x) >= 12) & ~unfit(x) & shows_address(x)))
    own = F.when(shows_address(maker["name"]), maker["name"])
    return F.when(maker.isNotNull(), F.coalesce(own, maker["address"], near, anywhere))


# --- all fields


def with_lines(scans: DataFrame) -> DataFrame:
    """scans (scan_id, text, ...) with tm_text ready for matching, tm_low in small letters, tm_lines and tm_full (without
    empty lines)."""
    cut = once(once(scans, tm_text=for_matching(F.coalesce("text", F.lit("")))), tm_lines=lines(F.col("tm_text")), tm_low=F.lower("tm_text"))
    return once(cut, tm_full=F.filter("tm_lines", lambda x: x != ""))


def raw_fields(scans: DataFrame, as_of: Column, only: tuple[str, ...] | None = None) -> DataFrame:
    """scans with a raw text (or null) for each declared field, or for those named in only."""
    a, full, text = F.col("tm_lines"), F.col("tm_full"), F.col("tm_text")
    worded = lambda name, value: F.when(reduce(or_, (F.contains("tm_low", F.lit(w)) for w in WORDS[name])), value)  # noqa: E731  # texts are only searched for labels whose words they have
    signs = lambda pattern, value: F.when(F.contains("tm_low", F.lit("by" if pattern == MADE_SIGNS else "at")) & text.rlike(pattern), value)
    of_text = {
        "mrp_raw": price(a),
        "net_quantity_raw": quantity(a),
        "packing_date_raw": packing_date(a, as_of),
        "use_by_raw": date_after(a, USE_BY_LABEL),
        "best_before_raw": date_after(a, BEST_BEFORE_LABEL),
        "care_raw": F.trim(found(text, CARE)),
        "batch_raw": found(text, BATCH),
        "origin_raw": F.trim(found(text, ORIGIN)),
    }
    of_text = {name: worded(name, value) for name, value in of_text.items()} | {
        "tm_maker": F.coalesce(
            signs(MADE_SIGNS, maker_explicit(full)), signs(AT_SIGNS, maker_at(full)), signs(MADE_SIGNS, maker_split(full)),
            F.when(F.upper(text).rlike(FORM_SIGNS), maker_scored(full)),
        ),
    }
    of_maker = ("maker_raw", "address_raw", "maker_address_raw")
    wanted = (*of_text, *of_maker) if only is None else only
    own = {k: v for k, v in of_text.items() if k in wanted or (k == "tm_maker" and set(of_maker) & set(wanted))}
    out = once(with_lines(scans), **own)
    if "tm_maker" in own:
        out = out.withColumn("maker_raw", F.col("tm_maker.name"))
        if {"address_raw", "maker_address_raw"} & set(wanted):
            out = once(out, address_raw=maker_address(full, F.col("tm_maker"))).withColumn("maker_address_raw", F.coalesce("address_raw", "maker_raw"))
    return out.drop("tm_maker", "tm_text", "tm_low", "tm_lines", "tm_full")


def normal_fields(raw: DataFrame) -> DataFrame:
    """Typed values beside the raw texts, which stay as they are. A field is found when its raw text is."""
    q = numbers.net_quantity(F.col("net_quantity_raw"))
    packed = dates.normal_date(F.col("packing_date_raw"))
    return once(raw, packing_date=packed).withColumns({
        "mrp": numbers.first_number(F.col("mrp_raw")),
        "mrp_currency": F.when(F.col("mrp_raw").isNotNull(), F.lit("INR")),
        "net_quantity": q["value"],
        "net_quantity_unit": q["unit"],
        "manufacturing_date": F.col("packing_date"),
        "use_by": dates.normal_date(F.col("use_by_raw")),
        "best_before": dates.normal_date(F.col("best_before_raw")),
        "manufacturer": F.col("maker_address_raw"),
        "customer_care": F.col("care_raw"),
    })
