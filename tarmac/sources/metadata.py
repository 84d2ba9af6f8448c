"""Metadata folders: JSON objects whose keys are ids, read as one row for each entry, and the class vocabulary."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The files of a metadata folder and the types of their entries, and the two fields of its vocabulary.
FILES = {
    "splits": ("splits.json", "array<string>"),
    "data_paths": ("segment_id_to_data_paths_rel.json", "map<string,string>"),
    "road_data": ("segment_id_to_road_data.json", "string"),
    "roads": ("road_id_to_segment_id_sequence.json", "array<string>"),
}
ATTRIBUTES = "attribute_metadata.json"
PLACES, CODES = "attribute_to_idx", "attribute_value_to_irap_number"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_object(spark: SparkSession, path: str, value: str = "string", optional: bool = False) -> DataFrame:
    """(place, key, value) of the entries of a JSON object in its order; ``value`` is a type, ``string`` keeps text or JSON.

    A file is one row until its entries are exploded, so it must fit into a task. A file that is no object gives an error;
    one that is not there gives no entries if it is ``optional``.
    """
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], f"place int, key string, value {value}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"}).alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("place", "e")).select("place", "e.key", "e.value")


def read_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(attribute, place, class_idx, code, value): attributes by their index, classes in the file's order."""
    whole = spark.read.text(str(PurePosixPath(folder) / ATTRIBUTES), wholetext=True).select(F.from_json("value", f"{PLACES} map<string,int>, {CODES} map<string,map<string,int>>", {"mode": "FAILFAST"}).alias("m")).select("m.*")
    each = whole.select(F.posexplode(F.array_sort(F.transform(F.map_entries(PLACES), lambda e: F.struct(e["value"], e["key"].alias("attribute"))))).alias("place", "a"), CODES)
    classes = F.posexplode(F.map_entries(F.element_at(CODES, F.col("a.attribute")))).alias("class_idx", "c")
    return each.select(F.col("a.attribute").alias("attribute"), "place", classes).select("attribute", "place", "class_idx", F.col("c.value").alias("code"), F.col("c.key").alias("value"))


def read_metadata(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a metadata folder by name; roads may be missing."""
    tables = {n: read_object(spark, str(PurePosixPath(folder) / f), t, optional=n == "roads") for n, (f, t) in FILES.items()}
    return tables | {"vocabulary": read_vocabulary(spark, folder)}


def write_object(entries: DataFrame, path: str, place: str = "place") -> None:
    """One JSON object of all entries (place, key, value) in their order, as a text file below ``path``; replaces what is there.

    Values of type string that hold a JSON object or list are written as such, as ``read_object`` gives them for entries of
    these kinds; other strings are written as strings. Numbers within them are written as they were read. The object is one
    row, so it must fit into a task, as for those who read it.
    """
    value = F.to_json(F.struct(F.col("value").alias("v")), {"ignoreNullFields": "false"})
    value = F.substring(value, 6, 1 << 30).substr(F.lit(1), F.length(value) - 6)
    if dict(entries.dtypes)["value"] == "string":
        nested = F.col("value").rlike(r"^\s*[\[{]") & F.get_json_object("value", "$").isNotNull()
        value = F.when(nested, F.col("value")).otherwise(value)
    key = F.to_json(F.array("key"))
    entry = F.concat(key.substr(F.lit(2), F.length(key) - 2), F.lit(":"), value)
    row = F.array_sort(F.collect_list(F.struct(place, entry.alias("entry"))))
    entries.groupBy().agg(row.alias("r")).select(F.concat(F.lit("{"), F.array_join("r.entry", ","), F.lit("}"))).write.mode("overwrite").text(path)
