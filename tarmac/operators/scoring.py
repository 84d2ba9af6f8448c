"""Scores of categorical predictions: sufficient statistics, class, attribute and averaged metrics.

Undefined values are null throughout; an infinite negative log likelihood is kept as infinity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_cells(df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts by keys, label and prediction; rows without a label are left out, an invalid prediction is null."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def probability_sums(df: DataFrame, keys: Sequence[str], label: str = "label", probs: str = "probs") -> DataFrame:
    """Support, and sums of negative log likelihood and Brier score, by keys and label, for rows with label and distribution."""
    own = F.get(F.col(probs), F.col(label)).cast("double")
    squares = F.aggregate(F.col(probs), F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double"))
    valid = df.where(F.col(label).isNotNull() & F.col(probs).isNotNull())
    nll = F.when(own == 0, F.lit(float("inf"))).otherwise(-F.ln(own))
    return valid.groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.sum(nll).alias("nll"), F.sum(1 - 2 * own + squares).alias("brier"))


def apply_null_policy(df: DataFrame, policy: str, pred: str = "pred") -> DataFrame:
    """Invalid predictions count as the first class (``first_class``) or are left out (``exclude``)."""
    if policy == "first_class":
        return df.withColumn(pred, F.coalesce(F.col(pred), F.lit(0)))
    if policy == "exclude":
        return df.where(F.col(pred).isNotNull())
    raise ValueError(f"unknown null policy: {policy}")


def class_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By keys and class: support, predicted, true positives, and P, R, F1 and IoU (0 where undefined).

    Classes that are neither labels nor predictions have no row, as means over classes leave them out.
    """
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")), F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"))))
    sums = cells.select(*keys, sides.alias("s")).where(F.col("s.class").isNotNull()).groupBy(*keys, F.col("s.class").alias("class"))
    out = sums.agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return out.select(
        "*",
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp")), F.lit(0.0)).alias("iou"),
    )


def attribute_metrics(classes: DataFrame, keys: Sequence[str], min_support: int | None = None) -> DataFrame:
    """From ``class_metrics``, by keys: n, accuracy, kappa, MCC and macro means; with ``min_support`` also means over classes of that support."""
    tp, sup, pre = (F.sum(c).cast("double") for c in ("tp", "support", "predicted"))
    chance = F.sum(F.col("support").cast("double") * F.col("predicted"))
    sup2, pre2 = F.sum(F.pow("support", F.lit(2))), F.sum(F.pow("predicted", F.lit(2)))
    n = pre
    top = tp * n - chance
    extra = []
    if min_support is not None:
        enough = F.col("support") >= min_support
        extra = [F.count_if(enough).alias("classes_supported"), F.avg(F.when(enough, F.col("f1"))).alias("mf1_supported")]
    return classes.groupBy(*keys).agg(
        F.sum("predicted").alias("n"),
        F.try_divide(tp, n).alias("accuracy"),
        F.try_divide(top, n * n - chance).alias("kappa"),
        F.try_divide(top, F.sqrt((n * n - pre2) * (sup * sup - sup2))).alias("mcc"),
        F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf1"),
        F.avg("iou").alias("miou"),
        *extra,
    )


def probability_metrics(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From ``probability_sums``, by keys: mean NLL and Brier over rows, and over classes."""
    return sums.groupBy(*keys).agg(
        F.try_divide(F.sum("nll"), F.sum("support")).alias("nll"),
        F.try_divide(F.sum("brier"), F.sum("support")).alias("brier"),
        F.avg(F.col("nll") / F.col("support")).alias("mnll"),
        F.avg(F.col("brier") / F.col("support")).alias("mbrier"),
    )


def average_over(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Means over attributes where a metric is defined, named with a leading ``a``."""
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(f"a{m}") for m in names])


def method_means(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Means over the models of a method: undefined if undefined for one model, exact if all are equal."""
    v = F.col(value)
    mean = F.when(F.count(v) < F.count(F.lit(1)), None).when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v))
    return metrics.groupBy(*keys).agg(mean.alias("mean"), F.count(F.lit(1)).alias("models"))


def weighted_cells(cells: DataFrame, weights: DataFrame, keys: Sequence[str], group: str = "sequence_id") -> DataFrame:
    """Cells by keys and resample: counts times the weights (resample, group, weight) of their groups; groups of weight 0 add nothing."""
    drawn = weights.where(F.col("weight") > 0)
    return cells.join(drawn, group).groupBy("resample", *keys, "label", "pred").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))


def percentile_interval(values: DataFrame, keys: Sequence[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Exact percentile intervals with linear interpolation; undefined values are left out and counted."""
    tail = (1 - confidence) / 2
    v = F.col(value)
    return values.groupBy(*keys).agg(F.percentile(v, F.lit(tail)).alias("low"), F.percentile(v, F.lit(1 - tail)).alias("high"), F.count_if(v.isNull()).alias("undefined"))


def paired_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Differences a - b of two methods in the same resamples; infinity minus infinity is undefined."""
    joined = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), list(keys))
    return joined.select(*keys, F.nullif(F.col("va") - F.col("vb"), F.lit(float("nan"))).alias("difference"))


def better_method(low: Column, high: Column, lower_is_better: bool = False) -> Column:
    """``a`` or ``b`` if the interval of a - b leaves out 0, else null."""
    first, second = ("b", "a") if lower_is_better else ("a", "b")
    return F.when(low > 0, F.lit(first)).when(high < 0, F.lit(second))


def masked_mean(df: DataFrame, keys: Sequence[str], value: str, mask: Column) -> DataFrame:
    """Mean of the defined values where the mask holds, null if there are none, and their number."""
    defined = mask & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(F.when(defined, F.col(value).cast("double"))).alias("mean"), F.count(F.when(defined, F.lit(1))).alias("n_defined"))
