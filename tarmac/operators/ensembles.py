"""Ensembles of predictions, and unions and intersections of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_mean(members: DataFrame, keys: Sequence[str], probs: str = "probs", weight: str = "weight") -> DataFrame:
    """Weighted mean distribution by keys; invalid members (null) are left out, and null if all are invalid."""
    rows = members.select(*keys, F.col(weight).alias("w"), F.posexplode_outer(probs).alias("class", "p"))
    sums = rows.groupBy(*keys, "class").agg(F.try_divide(F.sum(F.col("w") * F.col("p")), F.sum(F.when(F.col("p").isNotNull(), F.col("w")))).alias("p"))
    # At most one value per class stands in a list.
    lists = F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "p"))))
    return sums.groupBy(*keys).agg(F.transform(lists, lambda x: x["p"]).alias("probs")).withColumn("probs", F.when(F.size("probs") > 0, F.col("probs")))


def vote_shares(members: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """Votes and share of each predicted class by keys; invalid votes are left out."""
    from pyspark.sql import Window

    votes = members.where(F.col(pred).isNotNull()).groupBy(*keys, F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("share", F.col("votes") / F.sum("votes").over(Window.partitionBy(*keys)))


def common_keys(members: DataFrame, keys: Sequence[str], member: str, count: int) -> DataFrame:
    """Keys that all ``count`` members have."""
    return members.groupBy(*keys).agg(F.count_distinct(member).alias("members")).where(F.col("members") == count).select(*keys)


def all_keys(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that any member has."""
    return members.select(*keys).distinct()


def add_missing(predictions: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions with a row, invalid (null) in all other columns, for every key without one."""
    return keys.join(predictions, list(on), "left").select(*predictions.columns)
