"""Reports: long and wide tables of metrics and predictions, selections of segments, names and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key and metric: (keys, metric, value)."""
    return df.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def to_wide(df: DataFrame, row: str, column: str, names: Sequence[str], value: str, with_average: bool = True) -> DataFrame:
    """One row per ``row`` with a column per name; a last row ``average`` has the means over rows where defined."""
    wide = df.groupBy(row).pivot(column, list(names)).agg(F.first(value))
    if not with_average:
        return wide
    return wide.unionByName(wide.agg(*[F.avg(f"`{n}`").alias(n) for n in names]).withColumn(row, F.lit("average")))


def confident_errors(df: DataFrame, label: int, pred: int, confidence: Column, order: str) -> DataFrame:
    """Segments of a cell of the confusion matrix, the most confident predictions first."""
    cell = df.where((F.col("label") == label) & (F.col("pred") == pred))
    return cell.withColumn("place", F.row_number().over(Window.partitionBy("attribute").orderBy(confidence.desc(), order)))


def matching(df: DataFrame, segment: str, attribute: str, value: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Segments that have, for every attribute of ``wanted``, one of its values."""
    hit = None
    for a, values in wanted.items():
        one = (F.col(attribute) == a) & F.col(value).isin(values)
        hit = one if hit is None else hit | one
    return df.where(hit).groupBy(segment).agg(F.count_distinct(attribute).alias("_n")).where(F.col("_n") == len(wanted)).select(segment)


def log_priors(counts: DataFrame, keys: Sequence[str], n: str, classes: int) -> DataFrame:
    """Log shares of the classes with one added to every count."""
    total = F.sum(n).over(Window.partitionBy(*keys)) + classes
    return counts.withColumn("log_prior", F.ln((F.col(n) + 1) / total))


def metric_name(name: Column) -> Column:
    """Parts of a metric name such as ``amF1_supp10``: (base, averaged, min_support); nulls if it is none."""
    pattern = r"^(a?)(P|R|F1|IoU|mP|mR|mF1|mIoU|A|n|kappa|MCC|NLL|Brier|cNLL|cBrier|mNLL|mBrier|K)(?:_supp(\d+))?$"
    base = F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))
    least = F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")).cast("int")
    return F.when(base.isNotNull(), F.struct(base.alias("base"), (F.regexp_extract(name, pattern, 1) == "a").alias("averaged"), least.alias("min_support")))


def safe_name(name: Column, longest: int = 40) -> Column:
    """A file name: other characters become ``_``; names that are too long end in eight digits of their SHA-256."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
    return F.when(F.char_length(clean) > longest, F.concat(F.substring(clean, 1, longest - 9), F.lit("-"), F.substring(F.sha2(name, 256), 1, 8))).otherwise(clean)


def invalid_reason(probs: Column, classes: int, tolerance: float = 1e-4) -> Column:
    """Why an array is no distribution over the classes, or null: null arrays are invalid predictions, not errors."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(probs) != classes, "size").when(F.exists(probs, lambda p: F.isnan(p) | (p < 0)), "value").when(F.abs(total - 1) > tolerance, "sum")


def model_errors(models: DataFrame, method: str, seed: str, splits: str) -> DataFrame:
    """Methods whose models break a rule: several models and a missing or repeated seed, or different splits."""
    g = models.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.count(seed).alias("with_seed"), F.count_distinct(seed).alias("seeds"), F.count_distinct(splits).alias("splits"))
    rule = F.when((F.col("n") > 1) & (F.col("with_seed") < F.col("n")), "missing seed").when((F.col("n") > 1) & (F.col("seeds") < F.col("n")), "repeated seed").when(F.col("splits") > 1, "different splits")
    return g.select(method, rule.alias("error")).where("error is not null")


def near_on_road(df: DataFrame, road: str, position: str, columns: Sequence[str], centres: Column, radius: int) -> DataFrame:
    """Neighbours of the centre rows along their road, up to ``radius`` positions away: (center, offset, columns).

    Every centre is sent to the positions around it, so the join is by equality.
    """
    around = df.where(centres).select(road, F.col(columns[0]).alias("center"), F.col(position).alias("_at"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset"))
    around = around.where("offset <> 0").withColumn(position, F.col("_at") + F.col("offset"))
    return around.join(df.select(road, position, *columns), [road, position]).select("center", "offset", *columns)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``, its place in a fixed random order of the keys (a hash; a range sort, not one task)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def ratio_split(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``df`` with ``first``: whether a row falls into the first part, by the hash of its key, about ``share`` of all."""
    return df.withColumn("first", F.crc32(key.cast("string").cast("binary")) < share * 4294967296.0)


def rows_with_images(rows: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rows with the state of their image: ``matched`` (with its path), ``missing``, or ``ambiguous`` with several."""
    g = images.groupBy(key).agg(F.count(F.lit(1)).alias("images"), F.min("path").alias("path"))
    joined = rows.join(g, key, "left")
    state = F.when(F.col("images").isNull(), "missing").when(F.col("images") > 1, "ambiguous").otherwise("matched")
    return joined.withColumn("state", state).withColumn("path", F.when(F.col("images") == 1, F.col("path"))).drop("images")


def images_without_rows(images: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The images that no row names; those without a key are kept, as nothing can name them."""
    return images.join(rows.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def to_wide_intervals(df: DataFrame, row: str, column: str, names: Sequence[str], value: str, low: str, high: str) -> DataFrame:
    """One row per ``row`` with a column for each of the names and two more, ``<name>_low`` and ``<name>_high``, for its interval."""
    made = []
    for name in names:
        own = F.col(column) == name
        made += [F.max(F.when(own, F.col(c))).alias(name + end) for c, end in ((value, ""), (low, "_low"), (high, "_high"))]
    return df.groupBy(row).agg(*made)
