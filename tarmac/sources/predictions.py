"""Prediction files: Parquet with one row per segment and one column per attribute, and a header in the footer.

A column of lists holds distributions, one of integers holds class indices, and null is an invalid prediction. The
header is kept as metadata of the id column, which Spark writes to and reads from the footer itself.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADER = "header"


def output_kind(kind: T.DataType) -> str:
    """``soft`` for lists of numbers, ``hard`` for integers, ``empty`` for a column of nulls only."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return "soft"
    if isinstance(kind, T.IntegralType):
        return "hard"
    if isinstance(kind, T.NullType):
        return "empty"
    raise TypeError(f"no prediction column: {kind.simpleString()}")


def write_predictions(wide: DataFrame, path: str, header: dict, segment: str = "segment_id") -> None:
    """Writes ``wide`` with its header; columns are checked first, so that no half of a bad table is written."""
    for field in wide.schema:
        if field.name != segment and output_kind(field.dataType) == "empty":
            raise TypeError(f"column {field.name} has no type to write")
    text = json.dumps(header, sort_keys=True)
    soft = any(isinstance(f.dataType, T.ArrayType) for f in wide.schema)
    # Dictionaries help class indices only; distributions rarely repeat.
    wide.withMetadata(segment, {_HEADER: text}).write.option("parquet.enable.dictionary", str(not soft).lower()).parquet(path)


def read_header(spark: SparkSession, path: str, segment: str = "segment_id") -> dict:
    """The header of a prediction file, from its footer; no column is read. Empty if there is none."""
    return json.loads(spark.read.parquet(path).schema[segment].metadata.get(_HEADER, "{}"))


def to_long(wide: DataFrame, segment: str = "segment_id", classes: dict[str, int] | None = None) -> DataFrame:
    """(segment, attribute, probs, pred): one row per segment and attribute; ``probs`` or ``pred`` is null by the column's kind.

    With ``classes``, a distribution of another length than its attribute's number of classes raises an error.
    """
    entries = []
    for field in wide.schema:
        if field.name == segment:
            continue
        kind, value = output_kind(field.dataType), F.col(f"`{field.name}`")
        probs = value.cast("array<double>") if kind == "soft" else F.lit(None).cast("array<double>")
        if kind == "soft" and classes:
            n = classes[field.name]
            probs = F.when(value.isNull() | (F.size(value) == n), probs).otherwise(F.raise_error(F.lit(f"{field.name}: not {n} classes")).cast("array<double>"))
        pred = value.cast("int") if kind == "hard" else F.lit(None).cast("int")
        entries.append(F.struct(F.lit(field.name).alias("attribute"), probs.alias("probs"), pred.alias("pred")))
    return wide.select(F.col(segment).alias("segment_id"), F.explode(F.array(*entries)).alias("e")).select("segment_id", "e.*")


def to_wide(long: DataFrame, attributes: Sequence[str], value: str = "probs") -> DataFrame:
    """One row per segment, one column per attribute in the given order; absent cells are null."""
    cells = [F.first(F.when(F.col("attribute") == a, F.col(value)), ignorenulls=True).alias(a) for a in attributes]
    return long.groupBy("segment_id").agg(*cells)


def read_predictions(spark: SparkSession, path: str, segment: str = "segment_id", classes: dict[str, int] | None = None) -> DataFrame:
    """``to_long`` of a file."""
    return to_long(spark.read.parquet(path), segment, classes)
