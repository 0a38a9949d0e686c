"""Prices, quantities, units and article numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, found, let

#: Spellings of each unit.
UNITS = {"g": ("g", "gm", "gms", "gram", "grams"), "kg": ("kg", "kgs"), "ml": ("ml",), "l": ("l", "lt", "ltr", "litre", "litres", "liter")}
UNIT = r"kgs?|gms?|grams?|g|ml|ltr|lt|litres?|liter|l"
NUMBER_UNIT = rf"(?i)(\d+(?:\.\d+)?)\s*({UNIT})\b"
TOTAL = rf"(?i)=\s*(\d+(?:\.\d+)?)\s*({UNIT})?\b"


def unit_symbol(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = low
    for symbol, names in UNITS.items():
        out = F.when(low.isin(*names), F.lit(symbol)).otherwise(out)
    return out


def net_quantity(raw: Column) -> Column:
    """struct<value double, unit string>: the total after an equals sign if there is one, else the last number with a
    unit; null members where no number has a unit."""
    group = lambda n: F.regexp_extract_all(raw, F.lit(NUMBER_UNIT), F.lit(n))
    total = lambda n: F.when(F.contains(raw, F.lit("=")), found(raw, TOTAL, n))
    parts = F.struct(group(1).alias("values"), group(2).alias("units"), total(1).alias("total"), total(2).alias("total_unit"))

    def chosen(p: Column) -> Column:
        end = lambda c, at: F.try_element_at(c, F.lit(at))
        value = F.coalesce(p["total"], end(p["values"], -1))
        unit = F.when(p["total"].isNotNull(), F.coalesce(p["total_unit"], end(p["units"], 1))).otherwise(end(p["units"], -1))
        return let(F.when(F.size(p["units"]) > 0, F.struct(value.try_cast("double").alias("value"), unit.alias("unit"))), lambda x: F.struct(x["value"].alias("value"), unit_symbol(x["unit"]).alias("unit")))

    return F.when(raw.isNotNull(), let(parts, chosen))


def first_number(raw: Column) -> Column:
    return found(raw, r"(\d+\.?\d*)").try_cast("double")


def reference_price(text: Column) -> Column:
    """The first number of a catalogue's price text, commas and currency signs left out."""
    return found(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)").try_cast("double")


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.01


def plain_number(c: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros, as in 250, 0.5 or 1.5e+06. Digits are those of the
    exact value, halves to the even one; the exponent is that of the rounded value, so 999999.5 is 1e+06."""
    form = lambda v, pattern: F.call_function("format_number", v, pattern)

    def shown(x: Column) -> Column:
        power = x["power"].cast("int")
        fixed = form(x["v"], F.when(power > 4, F.lit("0")).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("#"), 5 - power))))
        scientific = F.concat(x["digits"], F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
        odd = F.when(F.isnan(x["v"]), "nan").when(x["v"] == float("inf"), "inf").when(x["v"] == float("-inf"), "-inf")
        return F.coalesce(odd, F.when((power < -4) | (power > 5), scientific).otherwise(fixed))

    def halved(x: Column) -> Column:
        """v, or a little less where it is the very half of an odd step above an even one: formats round halves up."""
        m, power = F.replace(F.substring_index(x["all"], "E", 1), F.lit("."), F.lit("")), F.substring_index(x["all"], "E", -1).try_cast("int")
        n, e = F.abs(m.try_cast("long")), power - 6
        # seven digits, the last a 5: an odd number times a power of ten, which a double is only if its odd factor fits
        exact = F.when(e < 0, n % F.pow(F.lit(5.0), F.least(-e, F.lit(10))).cast("long") == 0).otherwise(n * F.pow(F.lit(5.0), e) < 2.0**53)
        down = F.length(F.regexp_replace(m, "-", "")).eqNullSafe(7) & (n % 20 == 5) & exact
        return F.when(F.coalesce(down, F.lit(False)), x["v"] * (1 - 1e-9)).otherwise(x["v"])

    parts = lambda x: F.struct(x["v"].alias("v"), F.substring_index(x["shown"], "E", 1).alias("digits"), F.substring_index(x["shown"], "E", -1).try_cast("int").alias("power"))
    rounded = lambda v: F.struct(v.alias("v"), form(v, F.lit("0.#####E0")).alias("shown"))
    exact = lambda v: let(F.struct(v.alias("v"), form(v, F.lit("0.################E0")).alias("all")), lambda x: let(halved(x), lambda y: let(rounded(y), lambda z: let(parts(z), shown))))
    whole = lambda v: (v % 1 == 0) & (F.abs(v) >= 1) & (F.abs(v) < 1_000_000)
    return let(c.cast("double"), lambda v: F.when(v.isNull(), None).when(whole(v), v.cast("long").cast("string")).otherwise(exact(v)))


def check_digit(body: Column) -> Column:
    """Check digit of the first twelve digits of an article number: weights 1 and 3 in turn."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substr(body, i, F.lit(1)).cast("int") * (1 + 2 * ((i + 1) % 2)))
    return (10 - total % 10) % 10


def is_article_number(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{13}$"), check_digit(c) == F.substr(c, F.lit(13), F.lit(1)).cast("int")).otherwise(F.lit(False))


def windows(c: Column, size: int) -> Column:
    """All substrings of the given length."""
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(0), F.length(c) - size), lambda i: F.substr(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def article_numbers(digit_strings: Column) -> Column:
    """Sorted distinct valid 13-digit numbers that an array of recognised digit strings supports: as they stand, as
    windows of longer ones, or a 12-digit body with a stray single digit before or after it."""
    runs = F.filter(F.transform(digit_strings, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: (x != "") & (F.length(x) <= 20))

    def of(r: Column) -> Column:
        singles = F.array_distinct(F.filter(r, lambda x: F.length(x) == 1))
        bodies = F.flatten(F.transform(F.filter(r, lambda x: F.length(x) != 13), lambda x: windows(x, 12)))
        direct = F.flatten(F.transform(r, lambda x: windows(x, 13)))
        built = F.flatten(F.transform(bodies, lambda b: F.flatten(F.transform(singles, lambda s: F.array(F.concat(s, b), F.concat(b, s))))))
        return F.array_sort(F.array_distinct(F.filter(F.concat(direct, built), is_article_number)))

    return let(runs, of)


def only_one(a: Column) -> Column:
    return F.when(F.size(a) == 1, F.try_element_at(a, F.lit(1)))


def nonblank(c: Column) -> Column:
    return blank_to_null(F.trim(c))
