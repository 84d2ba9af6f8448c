"""Methods and their scored models, statistics of a release's splits and selections, and road sequences without labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators import roads
from tarmac.operators.labels import is_unlabeled


def method_scores(models: DataFrame, values: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(method, models, metric, value, error): means over a method's models of their metrics, averaged over attributes.

    ``models`` has method, model, seed and set_fingerprint, ``values`` model, attribute, metric and value. Models that can't
    be combined give one row with the error and no metric, the first that holds of: ``seeds`` (several models, and a seed
    is missing or comes twice), ``segments`` (different sets), ``metrics`` (another number of metrics and attributes, or
    others), ``attributes`` (one that is asked for isn't scored). A mean over attributes leaves undefined values out, one
    over models is undefined if a model's is.
    """
    if not attributes:
        raise ValueError("at least one attribute is required")
    scored = values.groupBy("model").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(F.concat_ws("\x01", "metric", "attribute")))), 256).alias("kinds"), F.array_sort(F.collect_set("attribute")).alias("scored"))
    joined = models.join(scored, "model", "left")
    seeds = (F.count(F.lit(1)) > 1) & ((F.count("seed") < F.count(F.lit(1))) | (F.count_distinct("seed") < F.count("seed")))
    lacks = F.size(F.array_except(F.array(*[F.lit(a) for a in attributes]), F.coalesce(F.min("scored"), F.array()))) > 0
    kinds = (F.count_distinct("kinds") > 1) | (F.count("kinds").between(1, F.count(F.lit(1)) - 1))
    error = F.when(seeds, "seeds").when(F.count_distinct(F.coalesce("set_fingerprint", F.lit(""))) > 1, "segments").when(kinds, "metrics").when(lacks, "attributes")
    states = joined.groupBy("method").agg(F.count(F.lit(1)).alias("models"), error.alias("error"))
    own = values.where(F.col("attribute").isin(*attributes)).groupBy("model", "metric").agg(F.avg("value").alias("v"))
    good = states.where("error is null").join(models.select("method", "model"), "method").join(own, "model")
    mean = F.when(F.count("v") == F.count(F.lit(1)), F.avg("v"))
    means = good.groupBy("method", "models", "metric").agg(mean.alias("value")).select("method", "models", "metric", "value", F.lit(None).cast("string").alias("error"))
    return means.unionByName(states.where("error is not null").select("method", "models", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), "error"))


def common_sets(scorings: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """(split, set): of the sets on which every scored model of a split has scores of the same segments, the first preferred.

    ``scorings`` has split, model, set and set_fingerprint. No row if there is no such set.
    """
    whole = scorings.groupBy("split").agg(F.count_distinct("model").alias("all"))
    per = scorings.where(F.col("set").isin(*preferred)).groupBy("split", "set").agg(F.count_distinct("model").alias("n"), F.count_distinct("set_fingerprint").alias("kinds"), F.count_if(F.col("set_fingerprint").isNull()).alias("unknown"))
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("set"))
    fit = per.join(whole, "split").where("n = all and kinds = 1 and unknown = 0")
    return fit.groupBy("split").agg(F.min_by("set", place).alias("set"))


def split_statistics(selections: DataFrame, sequences: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Statistics of each split in each selection, and of all labelled splits together (split null), in one aggregate.

    ``selections`` has split, selection, segment_id and labels; ``sequences`` segment_id and road_id. Columns: segments,
    sequences (distinct roads), without_labels (all missing), and for each attribute its labelled segments. Splits without
    labels count in no total.
    """
    rows = selections.join(sequences.select("segment_id", "road_id").dropDuplicates(["segment_id"]), "segment_id", "left")
    rows = rows.where(~is_unlabeled(F.col("split")))
    labelled = [F.count(F.get("labels", F.lit(i))).alias(a) for i, a in enumerate(attributes)]
    none = F.count_if(F.forall("labels", lambda x: x.isNull()))
    grouped = rows.groupingSets([["split", "selection"], ["selection"]], "split", "selection")
    return grouped.agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("road_id").alias("sequences"), none.alias("without_labels"), *labelled)


#: Orders of attributes and of classes: that of the schema, by number, or by imbalance.
ATTRIBUTE_ORDERS, CLASS_ORDERS = ("schema", "count", "imbalance"), ("schema", "count")


def ordered_distributions(counts: DataFrame, attribute_order: str = "schema", class_order: str = "schema") -> DataFrame:
    """``counts`` (attribute, place, class_idx, n) with ``attribute_rank`` and ``class_rank``, from 0; ties keep the schema's order.

    Attributes by ``count`` have the most labelled segments first; by ``imbalance`` the greatest ratio of the largest to the
    smallest class that has any, those without labels last. Classes by ``count`` have the most segments first.
    """
    if attribute_order not in ATTRIBUTE_ORDERS or class_order not in CLASS_ORDERS:
        raise ValueError(f"unknown order: {attribute_order}, {class_order}")
    totals = counts.groupBy("attribute", "place").agg(F.sum("n").alias("total"), (F.max("n") / F.min(F.when(F.col("n") > 0, F.col("n")))).alias("ratio"))
    first = {"schema": [], "count": [F.desc("total")], "imbalance": [F.desc_nulls_last("ratio")]}[attribute_order]
    # A row for each attribute of a vocabulary.
    ranks = totals.select("attribute", (F.row_number().over(Window.orderBy(*first, "place")) - 1).alias("attribute_rank"))
    own = Window.partitionBy("attribute").orderBy(*([F.desc("n")] if class_order == "count" else []), "class_idx")
    return counts.withColumn("class_rank", F.row_number().over(own) - 1).join(ranks, "attribute")


def unlabelled_sequences(recordings: DataFrame, sequences: DataFrame) -> DataFrame:
    """(road_id, place, segment_id): runs of consecutive segments of a recording that are in no road.

    ``recordings`` has recording and a numeric segment_id. A run ends at a missing number, so its spacing is even; its name
    has the recording and its first segment.
    """
    free = recordings.select("recording", "segment_id").distinct().join(sequences.select("segment_id").distinct(), "segment_id", "left_anti")
    numbered = roads.runs(free, "recording", "segment_id", 1)
    run = Window.partitionBy("recording", "run")
    name = F.concat(F.lit("unlabeled:"), "recording", F.lit(":"), F.min("segment_id").over(run).cast("string"))
    return numbered.select(name.alias("road_id"), (F.row_number().over(run.orderBy("segment_id")) - 1).alias("place"), "segment_id")


def splits_of_sequences(sequences: DataFrame, assignment: DataFrame) -> DataFrame:
    """(split, place, segment_id): segments of each split in order of their roads' names and places.

    ``assignment`` has road_id and split; roads without one are in no split. A segment of several roads of a split is listed
    once, at its first place.
    """
    seated = sequences.join(assignment.where("split is not null"), "road_id")
    first = seated.groupBy("split", "segment_id").agg(F.min(F.struct("road_id", "place")).alias("at"))
    # Places follow from roads' sizes, so no task orders a whole split.
    own = Window.partitionBy("split", "at.road_id").orderBy("at.place", "segment_id")
    numbered = first.withColumn("r", F.row_number().over(own))
    sizes = first.groupBy("split", F.col("at.road_id").alias("road_id")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("road_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("split", "road_id", before.alias("before"))
    met = numbered.withColumn("road_id", F.col("at.road_id")).join(offsets, ["split", "road_id"])
    return met.select("split", (F.col("before") + F.col("r") - 1).alias("place"), "segment_id")


def concatenated(datasets: Sequence[DataFrame], place: str = "place") -> DataFrame:
    """Rows of all datasets, one after the other: ``dataset`` is their number, places go on from one to the next."""
    if not datasets:
        raise ValueError("there is no dataset")
    whole = datasets[0].withColumn("dataset", F.lit(0))
    for i, d in enumerate(datasets[1:], 1):
        whole = whole.unionByName(d.withColumn("dataset", F.lit(i)))
    ends = whole.groupBy("dataset").agg((F.max(place) + 1).alias("_end"))
    before = F.coalesce(F.sum("_end").over(Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("dataset", before.alias("_before"))
    return whole.join(starts, "dataset").withColumn(place, F.col(place) + F.col("_before")).drop("_before")


def probabilities_with_mask(probs: Column, valid: Column, classes: int) -> tuple[Column, Column]:
    """Distributions and class indices of probabilities and a mask: null where the mask is false or null, or a value isn't finite.

    A distribution of another number of classes where the mask is true raises an error.
    """
    whole = F.coalesce(valid, F.lit(False)) & probs.isNotNull()
    checked = F.when(whole & (F.size(probs) != classes), F.raise_error(F.lit(f"not {classes} classes")).cast("array<double>")).otherwise(F.when(whole, probs.cast("array<double>")))
    finite = F.forall(checked, lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")))
    kept = F.when(finite, checked)
    return kept, (F.array_position(kept, F.array_max(kept)) - 1).cast("int")
