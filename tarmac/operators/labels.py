"""Class vocabularies, codes and class indices, labels of segments, and ordinals of a data set.

A vocabulary is a table (attribute, place, class_idx, code, value): the classes of every attribute, attributes in the
order of ``place``. It is broadcast only by Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions import codes

#: Ranges of keys that are numbered side by side.
RANGES = 64


def vocabulary(spark: SparkSession, classes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """The table of a mapping attribute -> value -> code, in its order."""
    rows = [(a, p, i, c, v) for p, (a, values) in enumerate(classes.items()) for i, (v, c) in enumerate(values.items())]
    return spark.createDataFrame(rows, "attribute string, place int, class_idx int, code int, value string")


def restricted(vocab: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The vocabulary of the given attributes, in their order; a ValueError for one that it lacks."""
    known = {r[0] for r in vocab.where(F.col("attribute").isin(*attributes)).select("attribute").distinct().collect()}
    if set(attributes) - known:
        raise ValueError(f"attributes not in the vocabulary: {sorted(set(attributes) - known)}")
    return vocab.withColumn("place", F.array_position(F.array(*map(F.lit, attributes)), F.col("attribute")).cast("int") - 1).where("place >= 0")


def class_indices(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """``long`` (attribute, code) with ``class_idx``; null for a missing code and for one that is no class."""
    return long.join(vocab.select("attribute", "code", "class_idx"), ["attribute", "code"], "left")


def unknown_codes(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """(attribute, code, n): codes that are no class of their attribute; empty if all are."""
    return long.where(codes.code(F.col("code")).isNotNull()).join(vocab, ["attribute", "code"], "left_anti").groupBy("attribute", "code").agg(F.count(F.lit(1)).alias("n"))


def predicted_codes(predictions: DataFrame, vocab: DataFrame, index: str) -> DataFrame:
    """``predictions`` (attribute, a class index) with ``code``; null for an invalid prediction."""
    return predictions.join(vocab.select("attribute", F.col("class_idx").alias(index), "code"), ["attribute", index], "left")


def segment_labels(segments: DataFrame, long: DataFrame, vocab: DataFrame, segment: str, strict: bool) -> DataFrame:
    """(segment, labels): one class index for each attribute, in the vocabulary's order, null where missing.

    With ``strict``, segments with a missing label are left out. ``long`` holds one code for each segment and attribute;
    of several, the label is that of the least class index. Aggregates combine before the shuffle.
    """
    names = [r[0] for r in vocab.groupBy("attribute").agg(F.min("place").alias("p")).orderBy("p").collect()]
    found = class_indices(long, vocab).groupBy(segment).agg(*[F.min(F.when(F.col("attribute") == a, F.col("class_idx"))).alias(f"l{i}") for i, a in enumerate(names)])
    parts = [F.col(f"l{i}") for i in range(len(names))]
    out = segments.select(segment).distinct().join(found, segment, "left").select(segment, F.array(*parts).alias("labels"))
    return out.where(F.forall("labels", lambda x: x.isNotNull())) if strict else out


def evaluated_attributes(labelled: DataFrame, vocab: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """(attribute, place, n): the candidates (all, or those wanted that there are) that have a label, ``n`` of them."""
    counts = labelled.where("class_idx is not null").groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    places = vocab.groupBy("attribute").agg(F.min("place").alias("place"))
    if wanted is not None:
        places = places.where(F.col("attribute").isin(*wanted))
    return places.join(counts, "attribute")


def is_unlabeled(split: Column) -> Column:
    """Whether a split holds segments without labels, by its name."""
    return split.startswith("unlabeled")


def location(flat: Column, fields: Column) -> Column:
    """(section, distance_m, length_m, lat, lon) of road data in either layout, km as metres; null if it has neither.

    ``flat`` has section, distance_km, length_km, lat and lon; ``fields`` Section, Distance, Length, Latitude, Longitude.
    """

    def made(source, names):
        section, distance, length, lat, lon = (source[n] for n in names)
        number = [c.cast("double") for c in (distance, length, lat, lon)]
        return F.struct(section.cast("string").alias("section"), (1000 * number[0]).alias("distance_m"), (1000 * number[1]).alias("length_m"), number[2].alias("lat"), number[3].alias("lon"))

    first = made(flat, ("section", "distance_km", "length_km", "lat", "lon"))
    second = made(fields, ("Section", "Distance", "Length", "Latitude", "Longitude"))
    return F.when(flat["distance_km"].isNotNull(), first).when(fields["Distance"].isNotNull(), second)


def first_codes(members: DataFrame, order: str) -> DataFrame:
    """(attribute, codes): those of the first member that predicts the attribute."""
    return members.groupBy("attribute").agg(F.min_by("codes", order).alias("codes"))


def differing_codes(members: DataFrame, order: str) -> DataFrame:
    """Members whose codes of an attribute are, as sets, not those of the first member that predicts it."""
    first = first_codes(members, order).withColumnRenamed("codes", "expected")
    return members.join(first, "attribute").where(F.array_sort(F.array_distinct("codes")) != F.array_sort(F.array_distinct("expected")))


def macro_prf(pairs: DataFrame, group: str, true: str, predicted: str) -> DataFrame:
    """Macro precision, recall and F1 for each group, over codes that are present on either side; 0 where undefined.

    Cells are counted first, so what follows the shuffle has a row for each pair of codes.
    """
    cells = pairs.groupBy(group, true, predicted).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col(true).alias("code"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q")), F.struct(F.col(predicted).alias("code"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"))))
    hit = F.when(F.col(true) == F.col(predicted), F.col("n")).otherwise(0)
    each = cells.select(group, hit.alias("hit"), side.alias("x")).groupBy(group, "x.code").agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q"), F.sum(F.when(F.col("x.s") > 0, F.col("hit")).otherwise(0)).alias("t"))
    p, r = (F.coalesce(F.try_divide(F.col("t"), F.col(c)), F.lit(0.0)) for c in "qs")
    f = 2 * F.col("t") / (F.col("s") + F.col("q"))
    return each.groupBy(group).agg(F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f).alias("macro_f1"))


def with_ordinal(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``ordinal``, the place of a row in the order of a numeric unique key, from 0; null keys go.

    Rows are numbered in ranges of about equal size; the ranges' limits are a few numbers that are found first, so that
    no task sees the whole table. Offsets are sums over the ranges' counts, which are found next. Rows that share a key lie in
    one range.
    """
    limits = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    above = F.array(*[F.lit(x) for x in sorted(set(limits))]) if limits else F.array().cast("array<bigint>")
    ranged = df.where(F.col(key).isNotNull()).withColumn("_range", F.size(F.filter(above, lambda x: x < F.col(key))))
    counts = dict(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # at most RANGES numbers
    before = F.array(*[F.lit(sum(n for r, n in counts.items() if r < i)).cast("long") for i in range(max(counts, default=0) + 1)])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_place", place).withColumn("ordinal", F.get(before, F.col("_range")) + F.col("_place") - 1).drop("_range", "_place")


def sliced(df: DataFrame, key: str, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """Rows ``start:stop:step`` in the order of the key, as a Python slice takes them; ``ordinal`` is kept."""
    numbered = with_ordinal(df, key)
    low, high, step = slice(start, stop, step).indices(df.where(F.col(key).isNotNull()).count())
    if step < 0:
        chosen = (F.col("ordinal") <= low) & (F.col("ordinal") > high)
        return numbered.where(chosen & ((F.lit(low) - F.col("ordinal")) % -step == 0))
    return numbered.where((F.col("ordinal") >= low) & (F.col("ordinal") < high) & ((F.col("ordinal") - low) % step == 0))


def exact_split(df: DataFrame, key: str, ratio: float | None = None, index: int | None = None) -> DataFrame:
    """``df`` with ``first``: whether a row is one of the first ``index`` rows, or of the first ``ratio`` of all, rounded half to even."""
    if (ratio is None) == (index is None):
        raise ValueError("either a ratio or an index")
    size = df.where(F.col(key).isNotNull()).count()
    at = round(ratio * size) if index is None else index + size * (index < 0)
    return with_ordinal(df, key).withColumn("first", F.col("ordinal") < at)


def weight_errors(members: DataFrame, ensemble: str, member: str, weight: str) -> DataFrame:
    """(ensemble, member, error): weights that are missing, not finite or not positive, and members that come twice."""
    bad = F.col(weight).isNull() | F.isnan(weight) | (F.col(weight) <= 0) | (F.col(weight) == float("inf"))
    weights = members.where(bad).select(ensemble, member, F.lit("weight").alias("error")).distinct()
    twice = members.groupBy(ensemble, member).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ensemble, member, F.lit("repeated").alias("error"))
    return weights.unionByName(twice)


def differing_keys(values: DataFrame, group: str, model: str, key: str) -> DataFrame:
    """(group, key, models, of): keys that some models of a group have and others lack."""
    pairs = values.select(group, model, key).distinct()
    of = pairs.groupBy(group).agg(F.count_distinct(model).alias("of"))
    return pairs.groupBy(group, key).agg(F.count(F.lit(1)).alias("models")).join(of, group).where("models < of")
