"""Column functions that parse cells of annotation tables. Null stands for missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(cell: Column) -> Column:
    """Null, NaN as text, or white space only."""
    return cell.isNull() | cell.cast("string").rlike(r"(?i)^\s*(nan)?\s*$")


def code(cell: Column) -> Column:
    """An integer code: digits with an optional sign; ``None``, negative and other values are null."""
    text = F.trim(cell.cast("string"))
    value = F.when(text.rlike(r"^-?\d{1,9}$"), F.try_to_number(text, F.lit("S999999999")).cast("int"))
    return F.when(value >= 0, value)


def is_bad_code(cell: Column) -> Column:
    """Whether a cell is neither missing nor an integer code."""
    text = F.trim(cell.cast("string"))
    return cell.isNotNull() & ~text.rlike(r"^(-?\d{1,9}|None|)$")


def lenient_int(cell: Column) -> Column:
    """``1.0`` is 1, ``3 text`` is 3, 2.5 and others are null."""
    text = F.trim(cell.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.cast("double"))
    lead = F.nullif(F.regexp_extract(text, r"^(\d{1,9}) ", 1), F.lit(""))
    return F.when(number == F.floor(number), number.cast("int")).when(number.isNull(), lead.cast("int"))


def lenient_float(cell: Column) -> Column:
    """A decimal number, with a comma or a point; others are null."""
    text = F.replace(F.trim(cell.cast("string")), F.lit(","), F.lit("."))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))


def segment_id(cell: Column) -> Column:
    """The id in a text: digits after ``seg_`` or ``id=``, else the first run of four or more digits."""
    named = F.nullif(F.regexp_extract(cell, r"(?:seg_|id=)(\d+)", 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.regexp_extract(cell, r"(\d{4,})", 1), F.lit("")))


def bucket(value: Column, limits: list[float]) -> Column:
    """1 for values from the first (largest) limit on, 2 from the second, and so on; one more below all; null for null."""
    out = None
    for i, low in enumerate(limits, 1):
        out = F.when(value >= low, i) if out is None else out.when(value >= low, i)
    return F.when(value.isNotNull(), out.otherwise(len(limits) + 1))


def timecode(text: Column) -> Column:
    """Seconds of ``ss``, ``mm:ss`` or ``hh:mm:ss``; null for other texts."""
    ok = text.rlike(r"^\d{1,6}(:\d{1,2}){0,2}(\.\d+)?$")
    return F.when(ok, F.aggregate(F.split(text, ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double")))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds for a row, null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def is_genuine(code: Column) -> Column:
    """Whether a code was given: neither null nor -1, which marks a missing one."""
    return code.isNotNull() & (code != -1)
