"""The archive of submissions: latest and stale rows, rankings, merges, groups by method, stems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, without a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def stale(submissions: DataFrame, scorings: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Submissions without a scoring of their current fingerprint."""
    return submissions.join(scorings.select(key, fingerprint), [key, fingerprint], "left_anti")


def orphans(scorings: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """Scorings whose submission is gone."""
    return scorings.join(submissions.select(key), key, "left_anti")


def rank(df: DataFrame, metric: Column, name: str, lower_is_better: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with a rank by metric: missing values last, ties by name."""
    signed = metric if lower_is_better else -metric
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(metric.isNull(), signed, name)))


def highlight(df: DataFrame, metric: str, value: str, lower_is_better: Column | bool = False) -> DataFrame:
    """``df`` with ``strength`` from 0 (worst) to 1 (best) within a metric; infinite and missing values have none, equal values 1."""
    w = Window.partitionBy(metric)
    finite = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    lo, hi = F.min(finite).over(w), F.max(finite).over(w)
    up = F.when(hi == lo, finite * 0 + 1).otherwise((finite - lo) / F.nullif(hi - lo, F.lit(0.0)))
    flip = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    return df.withColumn("strength", F.when(flip & (hi != lo), 1 - up).otherwise(up))


def later_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables, those of the newer one where both have a key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def collisions(df: DataFrame, key: Column, fingerprint: str, name: str = "kind") -> DataFrame:
    """Keys of several entries: identical (one fingerprint) or differing."""
    g = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fingerprint).alias("different")).where("n > 1")
    return g.select("key", "n", F.when(F.col("different") == 1, "identical").otherwise("differing").alias(name))


def method_summary(models: DataFrame, method: str, split: str, size: str, time: str) -> DataFrame:
    """By method: models, sorted splits, total size, first and last upload."""
    return models.groupBy(method).agg(
        F.count(F.lit(1)).alias("models"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.sum(size).alias("size"), F.min(time).alias("first_upload"), F.max(time).alias("last_upload")
    )


def resolve_stems(stems: DataFrame, wanted: DataFrame, stem: str = "stem") -> DataFrame:
    """The file of each wanted stem: the exact one, else the only one that begins with it; ``found`` counts candidates.

    Stems give their prefixes of the lengths that are asked for (few, and bounded by the longest name), and meet by equality.
    """
    w = wanted.select(F.col(stem).alias("wanted")).distinct()
    lengths = sorted(r[0] for r in w.select(F.char_length("wanted")).distinct().collect() if r[0] is not None)
    asked = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length(stem))
    prefixes = stems.select(F.col(stem).alias("found_stem"), F.explode(asked).alias("n")).select("found_stem", F.expr("substring(found_stem, 1, n)").alias("wanted"))
    hits = w.join(prefixes, "wanted", "left")
    g = hits.groupBy("wanted").agg(F.max(F.when(F.col("found_stem") == F.col("wanted"), F.col("found_stem"))).alias("exact"), F.count_distinct("found_stem").alias("found"), F.min("found_stem").alias("only"))
    out = g.select("wanted", F.coalesce("exact", F.when(F.col("found") == 1, F.col("only"))).alias("resolved"), "found")
    missing = w.join(out, "wanted", "left_anti").select("wanted", F.lit(None).cast("string").alias("resolved"), F.lit(0).cast("long").alias("found"))
    return out.unionByName(missing)


def disjoint_parts(df: DataFrame, predicates: dict[str, Column], rest: str = "rest", name: str = "part") -> DataFrame:
    """``df`` with the name of the first predicate that holds, each row in one part."""
    out = None
    for n, p in predicates.items():
        out = F.when(p, n) if out is None else out.when(p, n)
    return df.withColumn(name, out.otherwise(rest))
