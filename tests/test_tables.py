"""Headers and builds in small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import tables


def test_headers_and_suggestions(spark):
    headers = spark.createDataFrame([("f", h) for h in ("Road width", "SURFACE", "surface ", "Curvature ", "  ", "Slop", "Zebra", "Number of lanes")] + [("g", "x"), ("g", None)], "file string, header string")
    names = spark.createDataFrame([(n,) for n in ("Road width", "Surface", "Curve", "Curvature", "Slope", "Lanes", "Number of lane")], "name string")
    renames = spark.createDataFrame([("Curve", "zebra"), ("Lanes", "none")], "name string, header string")
    made = {(r.file, r.name): (r.header, r.how, r.suggestion) for r in tables.resolve_columns(headers, names, renames).collect()}
    assert len(made) == 14
    assert {n: made["f", n] for n in ("Road width", "Surface", "Curve", "Curvature", "Slope", "Lanes", "Number of lane")} == {
        "Road width": ("Road width", "exact", None),
        "Surface": ("SURFACE", "case", None),
        "Curve": ("Zebra", "rename", None),
        "Curvature": ("Curvature", "exact", None),
        "Slope": (None, "missing", "Slop"),
        "Lanes": (None, "missing", None),
        "Number of lane": (None, "missing", "Number of lanes"),
    }
    assert made["g", "Slope"] == (None, "missing", None)


def test_blocks_lose_no_similar_pair(spark):
    """All pairs of short names that are similar enough share two letters in a row."""
    words = ["".join(w) for n in (2, 3, 4, 5) for w in __import__("itertools").product("ab", repeat=n)]
    left = spark.createDataFrame([("f", w) for w in words], "file string, name string")
    right = spark.createDataFrame([("f", w + "c") for w in words], "file string, header string")
    met = {r.name: r.suggestion for r in tables.suggestions(left, right).collect()}
    far = F.levenshtein("name", "header") / F.greatest(F.length("name"), F.length("header"))
    every = left.crossJoin(right.drop("file")).withColumn("d", far).where(1 - F.col("d") >= tables.SIMILAR).groupBy("name").agg(F.min(F.struct("d", "header")).alias("b"))
    assert met == {r.name: r.b.header for r in every.collect()}


def test_equal_files_are_not_compared(spark, tmp_path):
    rows = [("same", i, str(i)) for i in range(10)] + [("same", 3, None), ("same", 3, "again")]
    old = spark.createDataFrame([*rows, ("diff", 1, "a"), ("diff", 2, None), ("diff", None, "n"), ("diff", 5, "x"), ("diff", 5, "y"), ("gone", 1, "q")], "file string, key long, value string")
    new = spark.createDataFrame([*reversed(rows), ("diff", 1, "b"), ("diff", 2, None), ("diff", None, "n"), ("diff", 5, "y"), ("diff", 5, "x"), ("diff", 9, "z")], "file string, key long, value string")
    made = tables.compare_builds(old, new)
    assert {tuple(r) for r in made.collect()} == {("same", "identical", 0, 0, 0), ("diff", "different", 0, 1, 1), ("gone", "old only", 1, 0, 0)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    once = spark.createDataFrame([("f", 1, "a"), ("f", 1, "a")], "file string, key long, value string")
    assert tables.compare_builds(once, once.distinct()).first().state == "different"
    assert tables.compare_builds(old, new.where("false")).where("state <> 'old only'").count() == 0
