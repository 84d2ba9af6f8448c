"""Resamples of groups of rows, drawn with replacement, and made-up predictions with errors that groups share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import arrays, draws
from tarmac.operators.labels import with_ordinal


def group_weights(groups: DataFrame, group: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, group, weight): how often each resample draws each group; groups that it doesn't draw have no row.

    Every resample draws as many groups as there are, with replacement, so its weights add up to their number. A draw is
    a function of seed, resample and its number, hence the same at any partitioning, and draws are counted before they are
    shuffled. ``group`` is numeric; rows that share one count once, null groups are left out.
    """
    if resamples < 1:
        raise ValueError(f"at least one resample is required, not {resamples}")
    distinct = groups.where(F.col(group).isNotNull()).select(group).distinct()
    n = distinct.count()
    if n < 1:
        raise ValueError("there are no groups to resample")
    each = groups.sparkSession.range(resamples * n).select(F.floor(F.col("id") / n).alias("resample"), (F.col("id") % n).alias("draw"))
    drawn = each.withColumn("ordinal", draws.below(F.lit(n), F.lit(seed), F.col("resample"), F.col("draw")))
    counts = drawn.groupBy("resample", "ordinal").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(with_ordinal(distinct, group), "ordinal").select("resample", group, "weight")


def group_weights_sql(groups: str, group: str, resamples: int, seed: int = 0) -> str:
    """DuckDB SQL of ``group_weights`` over a table or subquery."""
    return f"""SELECT resample, {group}, count(*) AS weight FROM (
            SELECT r AS resample, {draws.below_sql("n", str(seed), "r", "d")} AS ordinal
            FROM (SELECT count(DISTINCT {group}) AS n FROM {groups}), range({resamples}) t(r), range(n) u(d)) AS drawn
        JOIN (SELECT {group}, row_number() OVER (ORDER BY {group}) - 1 AS ordinal FROM (SELECT DISTINCT {group} FROM {groups} WHERE {group} IS NOT NULL)) USING (ordinal) GROUP BY ALL"""


def synthetic_logits(segments: DataFrame, segment: str, sequence: str, label: str, classes: int, strength: float = 2.0, shared: float = 0.5, seed: int = 0) -> DataFrame:
    """``segments`` with ``logits``: for each class a normal error, a part of which all segments of a sequence share.

    The labelled class gets ``strength`` on top; without a label none does. The errors have variance 1, of which ``shared``
    is that of the sequence, so segments of a sequence err alike, as a model does on one road. Ids are integers; a null
    id is an id of its own. Values depend on seed and ids alone, so they are the same at any partitioning.
    """
    if not 0 <= shared <= 1:
        raise ValueError(f"shared must lie between 0 and 1: {shared}")
    own_id, road = (F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 40))) for c in (segment, sequence))

    own, of_road = (draws.normals(draws.bits(F.lit(seed), F.lit(i), x), range(classes)) for i, x in ((1, own_id), (2, road)))
    errors = F.zip_with(own, of_road, lambda a, b: a * (1 - shared) ** 0.5 + b * shared**0.5)
    return segments.withColumn("logits", F.transform(errors, lambda e, k: e + F.when(F.col(label) == k, F.lit(strength)).otherwise(0.0)))


def synthetic_predictions(segments: DataFrame, segment: str, sequence: str, label: str, classes: int, **options) -> DataFrame:
    """``synthetic_logits`` with ``probs``, their softmax, and ``pred``, the first most probable class, in place of the logits."""
    made = synthetic_logits(segments, segment, sequence, label, classes, **options)
    made = made.withColumn("probs", arrays.softmax(F.col("logits"))).drop("logits")
    return made.withColumn("pred", arrays.argmax(F.col("probs")))
