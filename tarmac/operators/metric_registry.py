"""Metrics by name: names are compiled to one aggregate of only the statistics that they need.

A name is a base, with a leading ``a`` for the mean over attributes and a trailing ``_suppN`` for means over classes with
N labels at least: ``mF1``, ``amF1_supp10``, ``aNLL``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """How a base metric follows from the class table: by classes' columns, with what sums, and whether it is a mean over classes."""

    build: Callable[[Column], Column]
    probabilities: bool = False
    over_classes: bool = False


def _mean(column: str) -> Callable[[Column], Column]:
    return lambda enough: F.avg(F.when(enough, F.col(column)))


def _whole(build: Callable[[], Column]) -> Callable[[Column], Column]:
    return lambda enough: build()


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def _kappa() -> Column:
    n, chance = F.sum(_double("predicted")), F.sum(_double("support") * F.col("predicted"))
    return F.try_divide(F.sum("tp") * n - chance, n * n - chance)


def _mcc() -> Column:
    n, chance = F.sum(_double("predicted")), F.sum(_double("support") * F.col("predicted"))
    sides = [F.pow(F.sum(_double(c)), F.lit(2)) - F.sum(F.pow(c, F.lit(2))) for c in ("support", "predicted")]
    return F.try_divide(F.sum("tp") * n - chance, F.sqrt(sides[0] * sides[1]))


REGISTRY = {
    "A": Metric(_whole(lambda: F.try_divide(F.sum("tp"), F.sum("predicted")))),
    "kappa": Metric(_whole(_kappa)),
    "MCC": Metric(_whole(_mcc)),
    "mP": Metric(_mean("precision"), over_classes=True),
    "mR": Metric(_mean("recall"), over_classes=True),
    "mF1": Metric(_mean("f1"), over_classes=True),
    "mIoU": Metric(_mean("iou"), over_classes=True),
    "NLL": Metric(_whole(lambda: F.try_divide(F.sum("nll"), F.sum("support"))), probabilities=True),
    "Brier": Metric(_whole(lambda: F.try_divide(F.sum("brier"), F.sum("support"))), probabilities=True),
    "mNLL": Metric(lambda enough: F.avg(F.when(enough, F.try_divide("nll", "support"))), probabilities=True, over_classes=True),
    "mBrier": Metric(lambda enough: F.avg(F.when(enough, F.try_divide("brier", "support"))), probabilities=True, over_classes=True),
}
_NAME = re.compile(rf"(a?)({'|'.join(sorted(REGISTRY, key=len, reverse=True))})(?:_supp(\d+))?")


def parse(name: str) -> tuple[bool, str, int | None]:
    """Whether a name is that of a mean over attributes, its base and its least support."""
    found = _NAME.fullmatch(name)
    if not found or found[3] and not REGISTRY[found[2]].over_classes:
        raise ValueError(f"no metric: {name}")
    return bool(found[1]), found[2], int(found[3]) if found[3] else None


def protocol(kind: str) -> list[str]:
    """Names of what is reported for hard or soft predictions; the least support of rare classes' means is ten."""
    hard = [a + b for b in ("mF1", "mF1_supp10", "mIoU", "mP", "mR", "A", "kappa", "MCC") for a in ("a", "")]
    if kind == "hard":
        return hard
    if kind == "soft":
        return hard + [a + b for b in ("NLL", "Brier", "mNLL", "mBrier") for a in ("a", "")]
    raise ValueError(f"unknown kind of predictions: {kind}")


def cells(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, attribute, label, pred, n[, nll, brier]) of labelled rows; sums of distributions only if a name needs them.

    A label's probability of 0 has an infinite NLL; a row without a distribution adds nothing to these sums.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    if any(REGISTRY[parse(n)[1]].probabilities for n in names):
        own = F.get("probs", F.col("label")).cast("double")
        squares = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double"))
        sums += [F.sum(F.when(own == 0, float("inf")).otherwise(-F.ln(own))).alias("nll"), F.sum(1 - 2 * own + squares).alias("brier")]
    return rows.where("label is not null").groupBy(*keys, "attribute", "label", "pred").agg(*sums)


def from_cells(counted: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, attribute, metric, value) from ``cells``; means over attributes have a null attribute and leave undefined values out."""
    if not names:
        raise ValueError("no metric is asked for")
    parsed = {n: parse(n) for n in names}
    zero, soft = F.lit(0).cast("long"), "nll" in counted.columns
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero)
    extra = ["nll", "brier"] if soft else []
    labels = F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp"), *extra)
    preds = F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"), *[F.lit(0.0).alias(c) for c in extra])
    sides = counted.select(*keys, "attribute", F.explode(F.array(labels, preds)).alias("s")).where("s.class is not null")
    table = sides.groupBy(*keys, "attribute", F.col("s.class").alias("class")).agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp", *extra)])
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    table = table.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "iou": F.coalesce(F.try_divide(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp")), F.lit(0.0))})
    wanted = sorted({(base, least) for _, base, least in parsed.values()}, key=str)
    column = {w: f"m{i}" for i, w in enumerate(wanted)}
    each = table.groupBy(*keys, "attribute").agg(*[REGISTRY[b].build(F.col("support") >= (least or 0)).cast("double").alias(column[b, least]) for b, least in wanted])

    def long(frame, own, attribute):
        values = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(column[parsed[n][1:]]).alias("value")) for n in own]))
        return frame.select(*keys, attribute.alias("attribute"), values.alias("x")).select(*keys, "attribute", "x.*")

    means = [n for n in names if parsed[n][0]]
    single = [n for n in names if not parsed[n][0]]
    parts = [long(each, single, F.col("attribute"))] if single else []
    if means:
        averaged = each.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in column.values()])
        parts.append(long(averaged, means, F.lit(None).cast("string")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def metrics(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, attribute, metric, value) of rows with attribute, label and pred, and with probs where a name needs distributions."""
    return from_cells(cells(rows, keys, names), keys, names)


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], function: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, attribute, metric, value): a function of two results' values of the same keys, attribute and metric.

    Results that lack a value of the other raise an error, as they are of different metrics or attributes.
    """
    on = [*keys, "attribute", "metric"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    joined = a.withColumn("here", F.lit(True)).alias("a").join(b.withColumn("here", F.lit(True)).alias("b"), same, "full")
    lone = F.col("a.here").isNull() | F.col("b.here").isNull()
    value = F.when(lone, F.raise_error(F.lit("the results have different metrics or attributes")).cast("double")).otherwise(function(F.col("a.value"), F.col("b.value")))
    return joined.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in on], value.alias("value"))
