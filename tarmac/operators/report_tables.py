"""Tables of reports: methods by averages, two methods compared, labels of values, and the rows of the files that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "file string, sheet string, place long, cells array<string>"


def label_of(metric: Column, attribute: Column) -> Column:
    """The name of a mean over attributes as it is, of another metric with its attribute."""
    return F.when(attribute.isNull(), metric).otherwise(F.concat(metric, F.lit(" ("), attribute, F.lit(")")))


def method_average_table(values: DataFrame, models: DataFrame, intervals: DataFrame | None, metrics: Sequence[str]) -> DataFrame:
    """(method, models, null_policy, split_use, metrics, each with low and high if there are intervals).

    ``values`` has method, model, metric and value of means over attributes; ``models`` method, model, null_policy and
    split_use, which all models of a method share: another raises an error. A mean over models is undefined if one is.
    """
    own = models.groupBy("method").agg(F.count_distinct("model").alias("models"), F.min("null_policy").alias("null_policy"), F.min("split_use").alias("split_use"), F.max(F.struct("null_policy", "split_use")).alias("_h"), F.min(F.struct("null_policy", "split_use")).alias("_l"))
    same = F.when(F.col("_h").eqNullSafe(F.col("_l")), F.col("null_policy")).otherwise(F.raise_error(F.concat(F.lit("models of one method differ: "), F.col("method"))))
    own = own.select("method", "models", same.alias("null_policy"), "split_use")

    def mean(m):
        v = F.when(F.col("metric") == m, F.col("value"))
        return F.when(F.count(v) == F.count_if(F.col("metric") == m), F.avg(v)).alias(m)

    wide = values.groupBy("method").agg(*[mean(m) for m in metrics])
    order = list(metrics)
    if intervals is not None:
        ends = [F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m} {e}") for m in metrics for e in ("low", "high")]
        wide = wide.join(intervals.groupBy("method").agg(*ends), "method", "left")
        order = [c for m in metrics for c in (m, f"{m} low", f"{m} high")]
    return own.join(wide, "method", "left").select("method", "models", "null_policy", "split_use", *[F.col(f"`{c}`") for c in order])


def comparison_table(a: DataFrame, b: DataFrame, differences: DataFrame) -> DataFrame:
    """(metric, a, b, difference, low, high and, if an interval leaves out resamples, undefined), a row for each label.

    ``a`` and ``b`` have attribute, metric and value, ``differences`` attribute, metric, low, high and undefined.
    """
    keyed = [df.withColumn("label", label_of(F.col("metric"), F.col("attribute"))).drop("metric", "attribute") for df in (a, b, differences)]
    joined = keyed[0].withColumnRenamed("value", "a").join(keyed[1].withColumnRenamed("value", "b"), "label").join(keyed[2], "label")
    table = joined.select(F.col("label").alias("metric"), "a", "b", (F.col("a") - F.col("b")).alias("difference"), "low", "high", "undefined")
    return table if differences.where("undefined > 0").limit(1).count() else table.drop("undefined")


def partially_undefined(intervals: DataFrame) -> DataFrame:
    """(metric, undefined) of intervals that leave out some resamples, but not all."""
    part = intervals.where("undefined > 0 and low is not null and not isnan(low)")
    return part.select(label_of(F.col("metric"), F.col("attribute")).alias("metric"), "undefined")


def markdown(table: DataFrame, order: Sequence[str], digits: int = 4) -> DataFrame:
    """(place, line) of a table in Markdown: a head, a rule, then rows in order; doubles have ``digits`` digits, nulls are empty."""

    def text(name, kind):
        shown = F.format_string(f"%.{digits}f", F.col(f"`{name}`")) if kind in ("double", "float") else F.col(f"`{name}`").cast("string")
        return F.coalesce(F.replace(F.when(F.col(f"`{name}`").isNotNull(), shown), F.lit("|"), F.lit("\\|")), F.lit(""))

    lines = table.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[text(c, t) for c, t in table.dtypes]), F.lit(" |")).alias("line"))
    # The sort's partitions are in order, so their row numbers are too.
    body = lines.select((F.monotonically_increasing_id() + 2).alias("place"), "line")
    head = [(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + " --- |" * len(table.columns))]
    return table.sparkSession.createDataFrame(head, "place long, line string").unionByName(body)


def rows_of(table: DataFrame, file: Column, sheet: Column, place: Column) -> DataFrame:
    """Rows of a file's sheet, with text cells; the head comes first for every file and sheet that has rows."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in table.columns])
    body = table.select(file.alias("file"), sheet.alias("sheet"), place.cast("long").alias("place"), cells.alias("cells"))
    head = body.select("file", "sheet").distinct().select("file", "sheet", F.lit(-1).cast("long").alias("place"), F.array(*[F.lit(c) for c in table.columns]).alias("cells"))
    return head.unionByName(body)


def evaluation_files(values: DataFrame, metrics: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Rows of all files of a report, from (set, model, attribute, metric, value): for each evaluation set

    ``<set>/metrics.csv``, all values; ``<set>/<metric>.csv``, attributes by models with the mean last; and
    ``<set>/<model>.json``, one object of a model's values by label.
    """
    shown = values.withColumn("label", label_of(F.col("metric"), F.col("attribute")))
    long = rows_of(shown.select("set", "model", "metric", "attribute", "value"), F.concat("set", F.lit("/metrics.csv")), F.lit("metrics"), F.xxhash64("model", "metric", "attribute").bitwiseAND((1 << 62) - 1))
    wide = values.where(F.col("metric").isin(*metrics)).groupBy("set", "metric", "attribute").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])
    last = F.when(F.col("attribute").isNull(), F.lit(1 << 62)).otherwise(F.xxhash64("attribute").bitwiseAND((1 << 61) - 1))
    kept = F.struct(F.coalesce("attribute", F.lit("average")).alias("attribute"), *[F.col(f"`{m}`") for m in models])
    pivot = wide.select(F.concat("set", F.lit("/"), "metric", F.lit(".csv")).alias("file"), last.alias("place"), kept.alias("r"))
    body = pivot.select("file", F.lit("pivot").alias("sheet"), F.col("place").cast("long").alias("place"), F.array(*[F.col(f"r.`{c}`").cast("string") for c in ("attribute", *models)]).alias("cells"))
    head = body.select("file", "sheet").distinct().select("file", "sheet", F.lit(-1).cast("long").alias("place"), F.array(*[F.lit(c) for c in ("attribute", *models)]).alias("cells"))
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", finite.alias("v")))))
    documents = shown.groupBy("set", "model").agg(F.to_json(F.struct(F.first("set").alias("set"), F.first("model").alias("model"), entries.alias("values")), {"ignoreNullFields": "false"}).alias("json"))
    documents = documents.select(F.concat("set", F.lit("/"), "model", F.lit(".json")).alias("file"), F.lit("json").alias("sheet"), F.lit(0).cast("long").alias("place"), F.array("json").alias("cells"))
    return long.unionByName(head).unionByName(body).unionByName(documents)
