"""GPS tracks: cutting with interpolated ends, keyframes, paths, bearings, speeds and samples by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geo


def last_of_equal_times(points: DataFrame, track: str, t: str, order: str) -> DataFrame:
    """One point per time of a track, the last in order."""
    best = F.max_by(F.struct(*[c for c in points.columns if c not in (track, t)]), F.col(order))
    return points.groupBy(track, t).agg(best.alias("p")).select(track, t, "p.*")


def at_times(points: DataFrame, times: DataFrame, track: str, t: str, columns: list[str]) -> DataFrame:
    """Values of a track at given times, linear between the points around, clamped at both ends.

    Points and times are merged into one ordered sequence per track, so each is read once (no range join).
    """
    known = points.select(track, t, F.struct(F.col(t).alias("t"), *columns).alias("p"), F.lit(0).alias("asked"))
    wanted = times.select(track, t, F.lit(None).cast(known.schema["p"].dataType).alias("p"), F.lit(1).alias("asked")).distinct()
    orders = [F.col(t), F.col("asked")], [F.col(t).desc(), F.col("asked").desc()]
    back, on = (Window.partitionBy(track).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in orders)
    both = known.unionByName(wanted).withColumn("a", F.last("p", ignorenulls=True).over(back)).withColumn("b", F.last("p", ignorenulls=True).over(on)).where("asked = 1")
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    share = F.coalesce(F.try_divide(F.col(t) - a["t"], b["t"] - a["t"]), F.lit(0.0))
    return both.select(track, t, *[(a[c] + (b[c] - a[c]) * share).alias(c) for c in columns])


def cut(points: DataFrame, cuts: DataFrame, track: str, t: str, columns: list[str], bucket: float = 3600.0) -> DataFrame:
    """Points of every cut [start_s, end_s): interpolated ends and the points strictly inside, with times from the cut's start.

    Points meet cuts by track and time bucket, so that long tracks spread over tasks.
    """
    ends = cuts.select(track, F.explode(F.array("start_s", "end_s")).alias(t))
    edge = at_times(points, ends, track, t, columns)
    both = cuts.withColumn("edge_t", F.explode(F.array_distinct(F.array("start_s", "end_s"))))
    bounds = both.join(edge.withColumnRenamed(t, "edge_t"), [track, "edge_t"])
    outer = bounds.select(track, "cut_no", (F.col("edge_t") - F.col("start_s")).alias(t), *columns)
    spread = cuts.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket))))
    inner = points.withColumn("_b", F.floor(F.col(t) / bucket)).join(spread, [track, "_b"]).where(f"{t} > start_s and {t} < end_s")
    return outer.unionByName(inner.select(track, "cut_no", (F.col(t) - F.col("start_s")).alias(t), *columns)).distinct()


def previous_keyframe(requests: DataFrame, keyframes: DataFrame, track: str, t: str) -> DataFrame:
    """The last keyframe at or before each requested time, the first keyframe if there is none."""
    both = keyframes.select(track, t, F.col(t).alias("k"), F.lit(0).alias("asked")).unionByName(requests.select(track, t, F.lit(None).cast("double").alias("k"), F.lit(1).alias("asked")))
    w = Window.partitionBy(track)
    last = F.last("k", ignorenulls=True).over(w.orderBy(t, "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("keyframe", F.coalesce(last, F.min("k").over(w))).where("asked = 1").select(track, t, "keyframe")


def path(points: DataFrame, track: str, t: str) -> DataFrame:
    """``points`` (lat, lon) with the length of the way from the track's start."""
    w = Window.partitionBy(track).orderBy(t)
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("path_m", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def bearings(points: DataFrame, track: str, t: str) -> DataFrame:
    """``points`` with the bearing to the next point, the last one repeated."""
    w = Window.partitionBy(track).orderBy(t)
    own = geo.initial_bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    return points.withColumn("_b", own).withColumn("bearing", F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def speeds(points: DataFrame, track: str, t: str) -> DataFrame:
    """``points`` with the speed to the next point; unknown speeds (no time passes) repeat the one before."""
    w = Window.partitionBy(track).orderBy(t)
    dt = F.lead(t).over(w) - F.col(t)
    way = geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    return points.withColumn("_v", F.when(dt > 0, way / dt)).withColumn("speed", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v")


def every_metres(points: DataFrame, track: str, t: str, step: float) -> DataFrame:
    """The first point of each stretch of ``step`` metres along the way."""
    on = path(points, track, t).withColumn("stretch", F.floor(F.col("path_m") / step))
    return on.withColumn("_r", F.row_number().over(Window.partitionBy(track, "stretch").orderBy(t))).where("_r = 1").drop("_r")


def cuts_to_segments(times: DataFrame, track: str, t: str, duration: str) -> DataFrame:
    """Cut times of a video as segments [start, end) between 0 and its duration; equal times count once."""
    inside = F.array_sort(F.filter(F.collect_set(t), lambda x: x > 0))
    g = times.groupBy(track).agg(inside.alias("cs"), F.max(duration).alias("d"))
    starts = F.concat(F.array(F.lit(0.0)), F.filter("cs", lambda x: x < F.col("d")))
    ends = F.concat(F.filter("cs", lambda x: x < F.col("d")), F.array(F.col("d")))
    return g.select(track, F.posexplode(F.arrays_zip(starts.alias("start_s"), ends.alias("end_s"))).alias("cut_no", "s")).select(track, "cut_no", "s.*")


def course(points: DataFrame, track: str, t: str, east: str, north: str) -> DataFrame:
    """``points`` with ``course``, the way's angle from east, counter-clockwise in radians; the last point repeats it, a lone one has none."""
    w = Window.partitionBy(track).orderBy(t)
    ahead = points.withColumn("_c", F.atan2(F.lead(north).over(w) - F.col(north), F.lead(east).over(w) - F.col(east)))
    return ahead.withColumn("course", F.coalesce("_c", F.lag("_c").over(w))).drop("_c")


def sampling_rate(points: DataFrame, track: str, t: str) -> DataFrame:
    """(track, rate): steps for each second between the first and the last time; null without a duration."""
    return points.groupBy(track).agg(F.try_divide(F.count(t) - 1, F.max(t) - F.min(t)).alias("rate"))


def from_zero(points: DataFrame, track: str, t: str) -> DataFrame:
    """Times of each track counted from its first point."""
    first = points.groupBy(F.col(track).alias("_track")).agg(F.min(t).alias("_first"))
    return points.join(first, F.col(track).eqNullSafe(F.col("_track"))).withColumn(t, F.col(t) - F.col("_first")).drop("_track", "_first")
