"""Rules as queries: each returns the rows that break it, and none if all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_empty(violations: DataFrame, what: str, examples: int = 10) -> None:
    """Raises ValueError with some of the violations, if there are any."""
    found = violations.limit(examples).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, with their number; keys with a null count as any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differing(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """(group, field, values): fields that must be equal within a group and are not; null is a value of its own."""
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    each = df.select(group, sides.alias("s")).select(group, "s.*")
    counts = each.groupBy(group, "field").agg((F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("values"))
    return counts.where("values > 1")


def outside(df: DataFrame, index: Column, size: Column) -> DataFrame:
    """Rows whose class index is not in [0, size); a null index is no index."""
    return df.where(index.isNotNull() & ((index < 0) | (index >= size)))


def overlapping_splits(models: DataFrame, model: str, training: str, stopping: str, known: Sequence[str]) -> DataFrame:
    """(model, error): splits that are used for training and early stopping, listed twice, or unknown."""
    used = F.concat(F.coalesce(training, F.array().cast("array<string>")), F.coalesce(stopping, F.array().cast("array<string>")))
    twice = (F.size(F.array_distinct(training)) < F.size(training)) | (F.size(F.array_distinct(stopping)) < F.size(stopping))
    unknown = F.size(F.array_except(used, F.array(*map(F.lit, known)))) > 0
    error = F.when(unknown, "unknown split").when(twice, "split listed twice").when(F.arrays_overlap(training, stopping), "split used twice")
    return models.select(model, error.alias("error")).where("error is not null")


def road_errors(segments: DataFrame, members: DataFrame, segment: str, road: str) -> DataFrame:
    """(segment, error): segments in no road sequence, or, if labelled (column ``labelled``), in several."""
    roads = members.groupBy(segment).agg(F.count_distinct(road).alias("roads"))
    joined = segments.join(roads, segment, "left")
    error = F.when(F.col("roads").isNull(), "in no sequence").when(F.col("labelled") & (F.col("roads") > 1), "in several sequences")
    return joined.select(segment, error.alias("error")).where("error is not null")


def not_comparable(results: DataFrame, method: str, fields: Sequence[str], policy: str, invalid: str, reference: str) -> DataFrame:
    """(method, reason): methods whose results can't be compared with the reference's: another field, or invalid rows left out.

    One row per method is expected; the reference's single row goes to all tasks.
    """
    base = results.where(F.col(method) == reference).limit(1).select(*[F.col(c).alias(f"_{c}") for c in (*fields, invalid)])
    reason = None
    for c in fields:
        test = ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        reason = F.when(test, f"different {c}") if reason is None else reason.when(test, f"different {c}")
    reason = reason.when((F.col(policy) == "exclude") & (F.col(invalid) + F.col(f"_{invalid}") > 0), "invalid predictions left out")
    others = results.where(F.col(method) != reference).crossJoin(F.broadcast(base))  # one row by its limit
    return others.select(method, reason.alias("reason")).where("reason is not null")


def selection_errors(wanted: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """(key, error): keys wanted more than once, or not available."""
    counts = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    have = available.select(key).distinct().withColumn("_have", F.lit(True))
    error = F.when(F.col("n") > 1, "repeated").when(F.col("_have").isNull(), "missing")
    return counts.join(have, key, "left").select(key, error.alias("error")).where("error is not null")
