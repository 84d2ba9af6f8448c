"""Annotation tables: duplicates, annotator agreement, class distributions, coverage of splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_filled(df: DataFrame, keys: Sequence[str], filled: Column, order: Sequence[str]) -> DataFrame:
    """One row per key: that with most filled cells, the first in order among equals."""
    w = Window.partitionBy(*keys).orderBy(filled.desc(), *order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_report(df: DataFrame, reason: str = "drop_reason", by: Sequence[str] = ()) -> DataFrame:
    """Rows by drop reason (``kept`` if none), and by further columns."""
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def annotator_pairs(df: DataFrame, segment: str, annotator: str, code: str) -> DataFrame:
    """Counts of code pairs (code_a, code_b) of every ordered pair of annotators over the segments that both have coded.

    Pairs are made within a segment, whose number of annotators is small, and counted before anything is shuffled again.
    """
    one = df.where(F.col(code).isNotNull()).groupBy(segment, annotator).agg(F.min(code).alias("code"))
    a = one.select(segment, F.col(annotator).alias("a"), F.col("code").alias("code_a"))
    b = one.select(segment, F.col(annotator).alias("b"), F.col("code").alias("code_b"))
    return a.join(b, segment).where("a <> b").groupBy("a", "b", "code_a", "code_b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of agreement and Cohen's kappa by keys, from counts of code pairs; kappa is null if chance explains all."""
    w, n, zero = [*keys], F.col("n"), F.lit(0).cast("long")
    same = F.when(F.col("code_a") == F.col("code_b"), n).otherwise(zero)
    # Each line of counts is read once and stands for its two sides.
    sides = F.array(F.struct(F.col("code_a").alias("code"), n.alias("na"), zero.alias("nb"), same.alias("same")), F.struct(F.col("code_b").alias("code"), zero.alias("na"), n.alias("nb"), zero.alias("same")))
    margins = pairs.select(*w, F.inline(sides)).groupBy(*w, "code").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    both = margins.groupBy(*w).agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.when(F.col("code").isNotNull(), F.col("na") * F.col("nb"))).alias("chance"))
    n, expected = F.col("n").cast("double"), F.coalesce("chance", F.lit(0)).cast("double")
    return both.select(*w, "n", (F.col("same") / n).alias("agreement"), F.try_divide(F.col("same") * n - expected, n * n - expected).alias("kappa"))


def conflicts(df: DataFrame, segment: str, code: str, examples: int) -> DataFrame:
    """The segments with different codes, the most different first, up to ``examples``, and the count of all."""
    own = df.where(F.col(code).isNotNull()).groupBy(segment).agg(F.count_distinct(code).alias("codes")).where("codes > 1")
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return own.orderBy(F.desc("codes"), segment).limit(examples).crossJoin(F.broadcast(total))  # one row of fixed size


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts and shares of the values by keys; missing values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def balance(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From ``distribution``: labels, classes, share of the majority, imbalance ratio and effective classes."""
    return dist.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes"),
        F.max("share").alias("majority_share"),
        (F.max("n") / F.min("n")).alias("imbalance"),
        F.exp(-F.sum(F.col("share") * F.ln("share"))).alias("effective_classes"),
    )


def variation_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Total variation distance of two distributions (value, share)."""
    both = a.select(value, F.col("share").alias("pa")).join(b.select(value, F.col("share").alias("pb")), value, "full")
    return both.agg((F.lit(0.5) * F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))))).alias("distance"))


def majority_transfer(train: DataFrame, evaluated: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Accuracy on ``evaluated`` of always predicting the most frequent class of ``train``, the smallest among equals."""
    best = train.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
    shares = evaluated.select(*keys, value, "share")
    return best.join(shares, [*keys, value], "left").select(*keys, value, F.coalesce("share", F.lit(0.0)).alias("accuracy"))


def class_coverage(df: DataFrame, value: str, split: str, sequence: str, least: int) -> DataFrame:
    """By class and split: segments and sequences, and whether sequences are fewer than ``least``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value, split).agg(F.count(F.lit(1)).alias("segments"), F.count_distinct(sequence).alias("sequences"))
    return counts.withColumn("short", F.col("sequences") < least)


def majority_split(df: DataFrame, sequence: str, split: str, order: dict[str, int]) -> DataFrame:
    """The most frequent split of each sequence, ties by the order of splits, and whether its rows disagree."""
    counts = df.groupBy(sequence, split).agg(F.count(F.lit(1)).alias("n"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(split))
    return counts.groupBy(sequence).agg(F.min_by(split, F.struct(-F.col("n"), rank)).alias(split), (F.count(F.lit(1)) > 1).alias("conflict"))


def label_counts(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From ``distribution``: labelled segments, classes with labels, and the size of the smallest of them."""
    return dist.groupBy(*keys).agg(F.sum("n").alias("segments"), F.count_if(F.col("n") > 0).alias("classes"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("smallest"))


def overview(df: DataFrame, a: str, b: str, length: str) -> DataFrame:
    """Totals and subtotals of rows and lengths over two keys, with the shortest, median and longest length."""
    sums = df.groupingSets([[a, b], [a], []], a, b) if hasattr(df, "groupingSets") else df.rollup(a, b)
    return sums.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total"), F.min(length).alias("shortest"), F.percentile(length, F.lit(0.5)).alias("median"), F.max(length).alias("longest"))


def mapping_difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys only in the old mapping, only in the new one, or with another value."""
    both = old.select(key, F.col(value).alias("old"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("in_new")), key, "full")
    kind = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(key, kind.alias("kind"), "old", "new").where("kind is not null")


def regroupings(old: DataFrame, new: DataFrame, segment: str, group: str) -> DataFrame:
    """Old groups whose segments stand in several new groups: number of new groups and of segments."""
    both = old.select(segment, F.col(group).alias("old_group")).join(new.select(segment, F.col(group).alias("new_group")), segment)
    return both.groupBy("old_group").agg(F.count_distinct("new_group").alias("new_groups"), F.count(F.lit(1)).alias("segments")).where("new_groups > 1")


def centroids(df: DataFrame, sequence: str, columns: Sequence[str]) -> DataFrame:
    """Rows and the medians of the columns of each sequence."""
    return df.groupBy(sequence).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(c) for c in columns])


def missing_classes(df: DataFrame, value: str, split: str) -> DataFrame:
    """(value, missing): classes without a row in some split, and in how many splits."""
    total = df.agg(F.count_distinct(split).alias("_all"))
    counts = df.groupBy(value).agg(F.count_distinct(split).alias("_n"))
    return counts.crossJoin(F.broadcast(total)).where("_n < _all").select(value, (F.col("_all") - F.col("_n")).alias("missing"))  # one row of fixed size


def list_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one of two lists has more often, with ``kind`` (removed or added) and how many times more."""
    both = old.withColumn("_d", F.lit(-1)).unionByName(new.withColumn("_d", F.lit(1)))
    sums = both.groupBy(*old.columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return sums.select(*old.columns, F.when(F.col("_d") < 0, "removed").otherwise("added").alias("kind"), F.abs("_d").alias("n"))


def sibling_centroids(df: DataFrame, recording: str, labelled: Column, columns: Sequence[str]) -> DataFrame:
    """The unlabelled rows, with the medians of the labelled rows of their recording (null without any) in place of the columns."""
    medians = df.where(labelled).groupBy(F.col(recording).alias("_recording")).agg(*[F.median(c).alias(f"_{c}") for c in columns])
    open_ = df.where(~F.coalesce(labelled, F.lit(False))).drop(*columns)
    told = open_.join(medians, F.col(recording) == F.col("_recording"), "left")
    return told.select(*open_.columns, *[F.col(f"_{c}").alias(c) for c in columns])
