"""Templates of coding tables: which columns a table has, and what predictions fill them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a segment that a template may place in a column.
FIELDS = ("segment_id", "section", "distance", "length", "lat", "lon", "end_lat", "end_lon", "image")


@dataclass(frozen=True)
class Template:
    """The columns of a coding table in order; ``fields`` and ``attributes`` name the columns that are filled.

    Columns must be unique, and every filled one must be among them; no two fields or attributes share one.
    """

    columns: tuple[str, ...]
    fields: Mapping[str, str]
    attributes: Mapping[str, str]

    def __post_init__(self):
        def twice(names: Sequence[str]) -> list[str]:
            return sorted({n for n in names if list(names).count(n) > 1})

        filled = [*self.fields.values(), *self.attributes.values()]
        if found := twice(self.columns):
            raise ValueError(f"columns come twice: {found}")
        if found := sorted({*filled} - {*self.columns}):
            raise ValueError(f"the template has no such columns: {found}")
        if found := twice(filled):
            raise ValueError(f"columns are filled twice: {found}")
        if found := sorted({*self.fields} - {*FIELDS}):
            raise ValueError(f"no such fields: {found}")

    @classmethod
    def read(cls, text: str) -> Template:
        """From JSON with ``columns``, ``fields`` and ``attributes``."""
        spec = json.loads(text)
        return cls(tuple(spec["columns"]), spec["fields"], spec["attributes"])

    def unmapped(self, attributes: Sequence[str]) -> list[str]:
        """Attributes without a column, in the order given."""
        return [a for a in attributes if a not in self.attributes]

    def unfilled(self, attributes: Sequence[str]) -> list[str]:
        """Columns that predictions of these attributes leave blank, in order."""
        filled = {*self.fields.values()} | {self.attributes[a] for a in attributes if a in self.attributes}
        return [c for c in self.columns if c not in filled]


def fill(template: Template, segments: DataFrame, codes: DataFrame, order: Sequence[str] = ("road_id", "place")) -> DataFrame:
    """A row for each of the segments, in all columns of the template behind the columns of ``order``; blank cells are null.

    ``segments`` has segment_id, the columns of ``order`` and those of ``FIELDS`` that are there; ``codes`` has segment_id,
    attribute and code. Cells are texts. A segment without a code of an attribute has a null in its column, one of several
    codes has the least. Attributes without a column are left out (``Template.unmapped`` names them), as are codes of other
    segments. Codes become columns in one aggregate by segment with a known list of attributes; rows aren't sorted here, as a
    writer by ``order`` does that by ranges.
    """
    names = [*template.attributes]
    wide = codes.where(F.col("attribute").isin(names)).groupBy("segment_id").agg(*[F.min(F.when(F.col("attribute") == a, F.col("code"))).alias(f"_a{i}") for i, a in enumerate(names)])
    both = segments.join(wide, "segment_id", "left")
    of = {template.attributes[a]: F.col(f"_a{i}") for i, a in enumerate(names)} | {c: F.col(f) for f, c in template.fields.items() if f in segments.columns}
    return both.select(*order, *[(of[c] if c in of else F.lit(None)).cast("string").alias(c) for c in template.columns])


def coverage(template: Template, codes: DataFrame) -> DataFrame:
    """(name, kind, n): ``unmapped`` attributes of the codes with their rows, and ``unfilled`` columns of the template."""
    attributes = codes.groupBy("attribute").agg(F.count("code").alias("n"))
    spark = codes.sparkSession
    mapped = spark.createDataFrame([*template.attributes.items()], "attribute string, column string")
    unmapped = attributes.join(mapped, "attribute", "left_anti").select(F.col("attribute").alias("name"), F.lit("unmapped").alias("kind"), "n")
    open_ = spark.createDataFrame([(c,) for c in template.columns if c not in template.fields.values()], "column string")
    filled = attributes.join(mapped, "attribute").where("n > 0").select("column")
    unfilled = open_.join(filled, "column", "left_anti").select(F.col("column").alias("name"), F.lit("unfilled").alias("kind"), F.lit(0).cast("long").alias("n"))
    return unmapped.unionByName(unfilled)


def clashes(files: DataFrame, model: str, path: str) -> DataFrame:
    """(path, models, n): output paths that several models would take, whatever the case, with the models in order."""
    taken = files.groupBy(F.lower(path).alias("path"), model).agg(F.lit(1))
    return taken.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(model)).alias("models")).where("n > 1").select("path", "models", "n")


def misfits(predictions: DataFrame, vocabulary: DataFrame, members: DataFrame) -> DataFrame:
    """(model, reason, name, n): why new predictions don't fit a dataset; models that fit give no row.

    ``predictions`` has model, split, segment_id, attribute and code, ``vocabulary`` attribute and code, ``members`` split
    and segment_id. Reasons: ``split`` (the dataset has no such split), ``attribute`` (not in the vocabulary), ``code`` (not
    one of the attribute's, which is named), ``segments`` (predicted segments that aren't in the split), ``missing``
    (segments of the split without any prediction). ``n`` counts rows, for the last two segments. Codes that are null are
    invalid predictions and fit. Segments are compared only for splits that there are.
    """
    known_splits = members.select("split").distinct()
    known = vocabulary.select("attribute").distinct()
    counts = predictions.groupBy("model", "split", "attribute", "code").agg(F.count(F.lit(1)).alias("n"))
    split = counts.join(known_splits, "split", "left_anti").groupBy("model", F.col("split").alias("name")).agg(F.sum("n").alias("n")).withColumn("reason", F.lit("split"))
    attribute = counts.join(known, "attribute", "left_anti").groupBy("model", F.col("attribute").alias("name")).agg(F.sum("n").alias("n")).withColumn("reason", F.lit("attribute"))
    own = counts.where("code is not null").join(known, "attribute", "left_semi").join(vocabulary.select("attribute", "code"), ["attribute", "code"], "left_anti")
    code = own.groupBy("model", F.col("attribute").alias("name")).agg(F.sum("n").alias("n")).withColumn("reason", F.lit("code"))
    # One row per model and segment, whether predicted and whether a member; each model is asked for its split's members.
    told = predictions.select("model", "split", "segment_id").distinct().join(known_splits, "split", "left_semi").withColumn("predicted", F.lit(True))
    wanted = told.select("model", "split").distinct().join(members.select("split", "segment_id").distinct(), "split").withColumn("member", F.lit(True))
    both = told.join(wanted, ["model", "split", "segment_id"], "full")
    reason = F.when(F.col("member").isNull(), "segments").when(F.col("predicted").isNull(), "missing")
    segments = both.withColumn("reason", reason).where("reason is not null").groupBy("model", "reason", F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = segments.select("model", "reason", "name", "n")
    for part in (split, attribute, code):
        out = out.unionByName(part.select("model", "reason", "name", "n"))
    return out
