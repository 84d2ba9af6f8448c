"""Column functions that format and parse short texts of reports and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(x: Column, decimals: int) -> Column:
    """``decimals`` decimals without grouping; the number's exact value is rounded, ties to the even digit, as C's printf does."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * decimals))


def share_text(x: Column) -> Column:
    """A share in percent with one decimal, bounded where it would round to 0% or 100% without being it; undefined: empty."""
    undefined = x.isNull() | F.isnan(x)
    return F.when(undefined, "").when((x > 0) & (x < 0.0005), "<0.1%").when((x >= 0.9995) & (x < 1), ">99.9%").otherwise(F.concat(fixed_text(x * 100, 1), F.lit("%")))


def ratio_text(x: Column) -> Column:
    """A ratio with one decimal, from 10 on without; undefined: empty."""
    return F.when(x.isNull() | F.isnan(x), "").when(x >= 10, F.format_number(x, 0)).otherwise(fixed_text(x, 1))


def metric_text(x: Column, decimals: int, signed: bool = False) -> Column:
    """A value without a leading zero; ``NaN`` and infinities by name, null as a dash; with ``signed``, a plus before positive values."""
    plain = F.regexp_replace(fixed_text(x, decimals), r"^(-?)0\.", "$1.")
    text = F.when(x.isNull(), "–").when(F.isnan(x), "NaN").when(x == float("inf"), "∞").when(x == float("-inf"), "-∞").otherwise(plain)
    return F.when(F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)), F.concat(F.lit("+"), text)).otherwise(text) if signed else text


def offsets_text(offsets: Column) -> Column:
    """``-4..4`` for three or more offsets that ascend by one, else a list with commas."""
    n, first, last = F.size(offsets), F.element_at(offsets, 1), F.element_at(offsets, -1)
    consecutive = (n > 2) & (last - first == n - 1) & (offsets == F.transform(offsets, lambda x, i: first + i))
    return F.when(consecutive, F.concat(first.cast("string"), F.lit(".."), last.cast("string"))).otherwise(F.array_join(F.transform(offsets, lambda x: x.cast("string")), ","))


def optional_text(text: Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def seed(text: Column) -> Column:
    """(value, bad) of a seed as typed: null for a blank text, ``bad`` if it is no integer."""
    t = optional_text(text)
    ok = t.rlike(r"^[+-]?\d{1,18}$")
    return F.struct(F.when(ok, t.cast("long")).alias("value"), F.coalesce(~ok, F.lit(False)).alias("bad"))


def summary(description: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return optional_text(F.regexp_extract(description, r"(?m)^[^\S\n]*(\S[^\n]*)$", 1))


def typed(text: Column) -> Column:
    """(number, numbers, text) of a metadata value: one of them is set, by what the text holds."""
    t = optional_text(text)
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    one, many = t.rlike(f"^{number}$"), t.rlike(rf"^{number}(?:\s+{number})+$")
    return F.struct(
        F.when(one, t.cast("double")).alias("number"),
        F.when(many, F.transform(F.split(t, r"\s+"), lambda x: x.cast("double"))).alias("numbers"),
        F.when(~one & ~many, t).alias("text"),
    )


def degrees_of(text: Column) -> Column:
    """Decimal degrees of ``45 deg 7' 24.44" N``, negative for S and W; null for other texts."""
    pattern = r"""^\s*(\d{1,3}) deg (\d{1,2})' (\d{1,2}(?:\.\d+)?)" ([NSEW])\s*$"""
    d, m, s, side = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3, 4))
    value = d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
    return F.when(text.rlike(pattern), F.when(side.isin("S", "W"), -value).otherwise(value))


def finite(x: Column) -> Column:
    """NaN and infinities as null, for JSON."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
