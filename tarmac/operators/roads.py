"""Ordered road sequences: positions, context windows, runs, adjacency, interpolation and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, road: str, order: Sequence[str]) -> DataFrame:
    """``df`` with the position of each row in its road, from 0, and the road's length."""
    w = Window.partitionBy(road)
    return df.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("seq_len", F.count(F.lit(1)).over(w))


def longest_road(road_positions: DataFrame, segment: str = "segment_id", road: str = "road_id") -> DataFrame:
    """One row per segment: its place in the longest road that holds it, the first road and position among equals."""
    best = F.min_by(F.struct(road, "position", "seq_len"), F.struct(-F.col("seq_len"), F.col(road), F.col("position")))
    return road_positions.groupBy(segment).agg(best.alias("b")).select(segment, "b.*")


def context(df: DataFrame, road: str, order: str, segment: str, offsets: Sequence[int]) -> DataFrame:
    """``df`` with ``context``: the segments at the offsets in the same road, null outside of it."""
    w = Window.partitionBy(road).orderBy(order)
    return df.withColumn("context", F.array(*[F.lag(segment, -o).over(w) if o < 0 else F.lead(segment, o).over(w) for o in offsets]))


def complete_context(df: DataFrame, road: str, order: str, segment: str, offsets: Sequence[int], available: Column) -> DataFrame:
    """Rows whose whole context lies in the road and is available; availability is looked up before rows are dropped."""
    w = Window.partitionBy(road).orderBy(order)
    flagged = df.withColumn("_free", F.when(available, F.col(segment)))
    at = F.array(*[F.lag("_free", -o).over(w) if o < 0 else F.lead("_free", o).over(w) for o in offsets])
    return flagged.withColumn("context", at).where(F.forall("context", lambda c: c.isNotNull())).drop("_free")


def neighbours_agree(df: DataFrame, road: str, order: str, value: str, reach: int) -> DataFrame:
    """Rows with ``reach`` neighbours on both sides, all of the row's own value (such as its split)."""
    w = Window.partitionBy(road).orderBy(order).rowsBetween(-reach, reach)
    full = F.count(F.lit(1)).over(w) == 2 * reach + 1
    return df.withColumn("_ok", full & (F.min(value).over(w) == F.max(value).over(w))).where("_ok").drop("_ok")


def runs(df: DataFrame, group: str, value: str, max_step: float, name: str = "run") -> DataFrame:
    """``df`` with the number of its run, from 0: a step of more than ``max_step`` starts a new one."""
    w = Window.partitionBy(group).orderBy(value)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_new", (F.coalesce(step, F.lit(0)) > max_step).cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new")


def parts(df: DataFrame, section: str, start: str, length: str, tolerance: float, name: str = "part") -> DataFrame:
    """``df`` with its section's part, from 0: a part ends where the next row does not start at its end, within the tolerance."""
    w = Window.partitionBy(section).orderBy(start)
    gap = F.abs(F.col(start) - (F.lag(start).over(w) + F.lag(length).over(w)))
    return df.withColumn("_new", F.coalesce((gap > tolerance).cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w)).drop("_new")


def id_ranges(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row per group: its integers as ranges such as ``92-93, 468``."""
    own = runs(df.select(group, value).distinct(), group, value, 1)
    ends = own.groupBy(group, "run").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("lo", text.alias("t"))))
    return ends.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("ranges"))


def interpolate(df: DataFrame, road: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Missing values between two located rows of a road, by position; rows before the first or after the last stay null."""
    # What follows is the last of what stands before in reverse: frames that only grow are read once.
    before, after = (Window.partitionBy(road).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(order), F.col(order).desc()))
    located = F.forall(F.array(*columns), lambda c: c.isNotNull())
    known = F.when(located, F.struct(F.col(order).alias("o"), *columns))
    both = df.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.last(known, ignorenulls=True).over(after))
    share = F.coalesce(F.try_divide(F.col(order) - F.col("_a.o"), F.col("_b.o") - F.col("_a.o")), F.lit(0.0))
    made = [(F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * share).alias(c) for c in columns]
    return both.select(*[c for c in df.columns if c not in columns], *made)


def next_with(df: DataFrame, road: str, order: str, segment: str, has: Column) -> DataFrame:
    """``df`` with ``next_id``: the next later segment of the road for which ``has`` holds."""
    w = Window.partitionBy(road).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("next_id", F.last(F.when(has, F.col(segment)), ignorenulls=True).over(w))


def dense_numbers(df: DataFrame, value: str, order: Sequence[str], name: str = "number") -> DataFrame:
    """(value, number): distinct values numbered from 0 by first appearance. Only distinct values meet in one task."""
    first = df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first", value)) - 1).alias(name))


def shared_segments(road_positions: DataFrame, segment: str = "segment_id", road: str = "road_id") -> DataFrame:
    """Segments that stand in several roads, with the sorted roads."""
    roads = F.array_join(F.array_sort(F.collect_set(F.col(road).cast("string"))), ",")
    return road_positions.groupBy(segment).agg(F.count_distinct(road).alias("roads"), roads.alias("road_ids")).where("roads > 1")


def interleave(df: DataFrame, recording: str, segment: str, labelled: str, widest: int) -> DataFrame:
    """(recording, segment, previous, next): unlabelled segments between labelled ones of their recording that are at most ``widest`` apart."""
    mark = F.when(F.col(labelled), F.col(segment))
    back, on = (Window.partitionBy(recording).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(segment), F.col(segment).desc()))
    both = df.withColumn("previous", F.last(mark, ignorenulls=True).over(back)).withColumn("next", F.last(mark, ignorenulls=True).over(on))
    return both.where(~F.col(labelled) & (F.col("next") - F.col("previous") <= widest)).select(recording, segment, "previous", "next")
