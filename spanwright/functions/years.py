"""Year algebra on columns. Years are non-zero integers: -1 is 1 BCE, 1 is 1 CE; arithmetic skips year 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_astronomical(y: Column) -> Column:
    return F.when(y < 0, y + 1).otherwise(y)


def from_astronomical(a: Column) -> Column:
    return F.when(a <= 0, a - 1).otherwise(a)


def add_years(y: Column, n) -> Column:
    return from_astronomical(to_astronomical(y) + n)


def norm_year(y: Column, end: bool = False) -> Column:
    """Year 0 of a source: 1 as a start, -1 as an end."""
    return F.when(y == 0, F.lit(-1 if end else 1)).otherwise(y)


def span_years(lo: Column, hi: Column) -> Column:
    """Years of a closed interval; year 0 is none of them."""
    return hi - lo + 1 - F.when((lo < 0) & (hi > 0), 1).otherwise(0)


def year_distance(a: Column, b: Column) -> Column:
    return F.abs(to_astronomical(a) - to_astronomical(b))


def alive(lo: Column, hi: Column, year) -> Column:
    return (lo <= year) & (hi >= year)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def clamp_year(y: Column, lo: int, hi: int) -> Column:
    """The valid year nearest to a number inside [lo, hi]; halves round up, 0 moves to the side of the sign."""
    r = F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(y + 0.5))).cast("int")
    positive = F.lit(1 if hi >= 1 else -1)
    negative = F.lit(-1 if lo <= -1 else 1)
    return F.when(r == 0, F.when(y < 0, negative).otherwise(positive)).otherwise(r)


def format_year(y: Column, era: str = "BCE", ce: bool = False) -> Column:
    after = (F.concat(F.lit("AD "), y.cast("string")) if era == "BC" else F.concat(y.cast("string"), F.lit(" CE"))) if ce else y.cast("string")
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(f" {era}"))).otherwise(after)


def format_span(lo: Column, hi: Column, present: int = 2026) -> Column:
    """'500 BCE - 33' with a spaced dash before the common era, '33-present' without."""
    end = F.when(hi >= present, F.lit("present")).otherwise(format_year(hi))
    dash = F.when(lo < 0, F.lit(" – ")).otherwise(F.lit("–"))
    return F.when(lo == hi, format_year(lo)).otherwise(F.concat(format_year(lo), dash, end))


def parse_year(text: Column) -> Column:
    """The year of a typed text: an optional sign or one era, digits with optional thousands commas; else null."""
    s = F.lower(F.trim(text))
    s = F.regexp_replace(s, "[‐-―−﹘﹣－]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"([a-z])\.", "$1"), r"\s+", " ")
    pattern = r"^([+-])?\s*(?:(bce|bc|ce|ad)\s*)?(\d{1,3}(?:,\d{3})+|\d+)\s*(bce|bc|ce|ad)?$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    sign, before, digits, after = part(1), part(2), part(3), part(4)
    era = F.when(before != "", before).otherwise(after)
    n = F.regexp_replace(digits, ",", "").try_cast("bigint")
    bad = (digits == "") | ((before != "") & (after != "")) | ((sign != "") & (era != "")) | n.isNull() | (n == 0)
    return F.when(~bad, F.when((sign == "-") | era.isin("bc", "bce"), -n).otherwise(n))


def century(y: Column) -> Column:
    """1 for years 1 to 100, -1 for 100 BCE to 1 BCE."""
    return F.when(y > 0, F.ceil(y / 100)).otherwise(-F.ceil(-y / 100)).cast("int")


def chunk_id(lo: Column, hi: Column) -> Column:
    name = lambda y: F.when(y < 0, F.concat((-y).cast("string"), F.lit("bce"))).otherwise(y.cast("string"))
    return F.concat_ws("-", name(lo), name(hi))


def date_tolerance(lo: Column, hi: Column) -> Column:
    """Years by which a date may be off: a tenth of the span, 25 at least."""
    return F.greatest(F.lit(25), F.bround(span_years(lo, hi) * 0.1).cast("int"))
