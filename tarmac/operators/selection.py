"""Segments of all splits of a release that a dataset yields: image, then labels, then context, then the subset of a release."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import roads
from tarmac.operators.labels import is_unlabeled

#: The steps of the selection in their order; each has the rows that passed it and all before.
STEPS = ("listed", "image", "labels", "road", "context", "subset")


@dataclass(frozen=True)
class Preset:
    """How a release is loaded: places of the context relative to a segment, and which filters hold."""

    offsets: tuple[int, ...] = (0,)
    allow_missing: bool = False
    use_subset: bool = False


def passed_steps(splits: DataFrame, images: DataFrame, labels: DataFrame, sequences: DataFrame, attributes: list[str], preset: Preset, subset: DataFrame | None = None) -> DataFrame:
    """(split, place, segment_id, path, labels, road_id, context, passed) of all listed segments; ``passed`` counts steps.

    ``splits`` has split, place and segment_id; ``images`` segment_id and path; ``labels`` segment_id, attribute and
    class_idx; ``sequences`` road_id, place and segment_id; ``subset`` segment_id. All splits are selected in one pass.

    A segment needs an image; labels of all attributes, unless missing ones are allowed or its split is unlabelled; a
    road, the longest that holds it; a context whose every segment lies in that road and has an image, whatever its split;
    and a place in the subset, if the preset uses one and the split is labelled. A segment that has several images has the
    first path, one that several rows label the least class. A subset that is asked for but not given is an error.
    """
    if preset.use_subset and subset is None:
        raise ValueError("the preset needs a subset of segments")
    first_image = images.where("path is not null").groupBy("segment_id").agg(F.min("path").alias("path"))
    own = labels.where(F.col("attribute").isin(*attributes)).groupBy("segment_id").agg(*[F.min(F.when(F.col("attribute") == a, F.col("class_idx"))).alias(f"_l{i}") for i, a in enumerate(attributes)])
    own = own.select("segment_id", F.array(*[F.col(f"_l{i}") for i in range(len(attributes))]).alias("labels"))
    # Contexts are those of the whole roads, so they are found before any split is looked at.
    seated = roads.positions(sequences, "road_id", ["place"]).join(first_image.withColumnRenamed("path", "_image"), "segment_id", "left")
    around = roads.context(seated.withColumn("_free", F.when(F.col("_image").isNotNull(), F.col("segment_id"))), "road_id", "place", "_free", preset.offsets)
    longest = F.struct(-F.col("seq_len"), F.col("road_id"), F.col("position"))
    best = around.groupBy("segment_id").agg(F.min_by(F.struct("road_id", "context"), longest).alias("_b"))
    none = F.array(*[F.lit(None).cast("int") for _ in attributes])
    rows = splits.select("split", "place", "segment_id").join(first_image, "segment_id", "left").join(own, "segment_id", "left").join(best, "segment_id", "left")
    free = is_unlabeled(F.col("split"))
    rows = rows.withColumn("labels", F.when(free, none).otherwise(F.coalesce("labels", none)))
    inside = F.lit(True)
    if preset.use_subset:
        rows = rows.join(subset.select("segment_id").distinct().withColumn("_in", F.lit(True)), "segment_id", "left")
        inside = F.coalesce("_in", F.lit(False)) | free
    steps = [
        F.lit(True),
        F.col("path").isNotNull(),
        F.lit(preset.allow_missing) | free | F.forall("labels", lambda x: x.isNotNull()),
        F.col("_b").isNotNull(),
        F.coalesce(F.forall("_b.context", lambda c: c.isNotNull()), F.lit(False)),
        inside,
    ]
    passed, open_ = F.lit(0), F.lit(True)
    for step in steps:
        open_ = open_ & step
        passed = passed + open_.cast("int")
    return rows.select("split", "place", "segment_id", "path", "labels", F.col("_b.road_id").alias("road_id"), F.col("_b.context").alias("context"), passed.alias("passed"))


def selected(steps: DataFrame) -> DataFrame:
    """Segments that passed all steps; in order of split and place they are those of the release's splits."""
    return steps.where(F.col("passed") == len(STEPS)).drop("passed")


def step_counts(steps: DataFrame) -> DataFrame:
    """(split, one count for each step) of ``passed_steps``."""
    return steps.groupBy("split").agg(*[F.count_if(F.col("passed") > i).alias(s) for i, s in enumerate(STEPS)])


def labelled_counts(chosen: DataFrame, attributes: list[str]) -> DataFrame:
    """(split, attribute, n): how many selected segments have a label, 0 if none."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in attributes]).alias("attribute"), F.col("labels").alias("label")))
    return chosen.select("split", pairs.alias("x")).groupBy("split", F.col("x.attribute").alias("attribute")).agg(F.count("x.label").alias("n"))
