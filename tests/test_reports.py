"""Report files: what is read back, names that clash, writers that fail midway; tables and selections in small cases."""

from __future__ import annotations

import csv
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tarmac.operators import report_tables, selection
from tarmac.sources import report_files
from tarmac.sources.spreadsheets import read_sheets

VALUES = "set string, model string, attribute string, metric string, value double"


def values(spark):
    rows = [(s, m, a, "mF1", v) for s in ("full", "north") for m, v in (("m1", 0.5), ("m2", float("inf"))) for a in ("surface", "curve, left", None)]
    return spark.createDataFrame([*rows, ("full", "m1", None, "aA", None)], VALUES)


def test_a_report_is_read_back(spark, tmp_path):
    path = str(tmp_path)
    report_files.write_reports(report_tables.evaluation_files(values(spark), ["mF1"], ["m1", "m2"]), path)
    found = {r.file: r for r in report_files.valid_files(spark, path).collect()}
    assert sorted(found) == ["full/m1.json", "full/m2.json", "full/mF1.csv", "full/metrics.csv", "north/m1.json", "north/m2.json", "north/mF1.csv", "north/metrics.csv"]
    for r in found.values():
        data = open(r.location, "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.size, r.sha256)
        assert data.startswith(b"\xef\xbb\xbf") == r.file.endswith(".csv")
    pivot = list(csv.reader(open(found["full/mF1.csv"].location, encoding="utf-8-sig", newline="")))
    assert pivot[0] == ["attribute", "m1", "m2"] and pivot[-1] == ["average", "0.5", "Infinity"] and sorted(pivot[1:-1]) == [["curve, left", "0.5", "Infinity"], ["surface", "0.5", "Infinity"]]
    assert len(list(csv.reader(open(found["full/metrics.csv"].location, encoding="utf-8-sig", newline="")))) == 8
    document = json.load(open(found["full/m1.json"].location))
    assert document == {"set": "full", "model": "m1", "values": {"aA": None, "mF1": 0.5, "mF1 (curve, left)": 0.5, "mF1 (surface)": 0.5}}
    assert json.load(open(found["full/m2.json"].location))["values"]["mF1"] is None


def test_workbooks(spark, tmp_path):
    texts = ["007", "-1.5", "1e5", "12", "a<b & \"c\"", "x\x00y", None, "é", "0.10", " s "]
    rows = [("t.xlsx", "a codes", -1, ["name", "n"])] + [("t.xlsx", "a codes", i, [t, str(i)]) for i, t in enumerate(texts)] + [("t.xlsx", "b", 0, ["second"])]
    report_files.write_reports(spark.createDataFrame(rows, report_tables.CELLS), str(tmp_path))
    where = report_files.valid_files(spark, str(tmp_path)).first().location
    got = [r.cells for r in read_sheets(spark, where).orderBy("row").collect()]
    assert got == [["name", "n"]] + [[t.replace("\x00", "") if t else t, str(i)] for i, t in enumerate(texts)]
    import zipfile

    with zipfile.ZipFile(where) as book:
        assert b"second" in book.read("xl/worksheets/sheet2.xml") and b'name="b"' in book.read("xl/workbook.xml")
        assert b"<v>-1.5</v>" in book.read("xl/worksheets/sheet1.xml") and b"<v>007" not in book.read("xl/worksheets/sheet1.xml")


@pytest.mark.parametrize("names", [("a.csv", "A.csv"), ("../a.csv",), ("/a.csv",), ("a.exe",), ("a/.csv",)])
def test_names_that_clash(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "s", 0, ["x"]) for n in names], report_tables.CELLS)
    with pytest.raises(ValueError, match="clash"):
        report_files.write_reports(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_writer_that_fails_leaves_the_report_before(spark, tmp_path):
    path = str(tmp_path)
    good = spark.createDataFrame([("a.csv", "s", i, [str(i)]) for i in range(5)], report_tables.CELLS)
    bad = good.withColumn("cells", F.when(F.col("place") == 3, F.raise_error(F.lit("midway")).cast("array<string>")).otherwise(F.array(F.lit("new"))))
    with pytest.raises(Exception, match="midway"):
        report_files.write_reports(bad, path)
    assert report_files.valid_files(spark, path).count() == 0
    report_files.write_reports(good, path)
    before = report_files.valid_files(spark, path).first()
    slow = spark.createDataFrame([("a.csv", "s", 0, ["new"]), ("b.csv", "s", 0, ["new"])], report_tables.CELLS)
    commit, report_files._ReportWriter.commit = report_files._ReportWriter.commit, lambda self, messages: 1 / 0
    try:  # all tasks have written, the manifest hasn't
        with pytest.raises(Exception):
            report_files.write_reports(slow.withColumn("place", F.col("place") / 0), path)
    finally:
        report_files._ReportWriter.commit = commit
    assert report_files.valid_files(spark, path).first() == before and open(before.location, encoding="utf-8-sig").read().split() == list("01234")
    report_files.write_reports(slow, path)
    assert report_files.valid_files(spark, path).count() == 2 and report_files.clean(path) >= 1 and report_files.clean(path) == 0
    assert report_files.valid_files(spark, path).where("file = 'b.csv'").count() == 1


def test_tables(spark):
    v = spark.createDataFrame([("x", "A", 0.5), (None, "aA", 0.25)], "attribute string, metric string, value double")
    d = spark.createDataFrame([("x", "A", -0.1, 0.1, 0), (None, "aA", float("nan"), float("nan"), 9)], "attribute string, metric string, low double, high double, undefined long")
    assert report_tables.comparison_table(v, v, d.where("undefined = 0")).columns == ["metric", "a", "b", "difference", "low", "high"]
    assert {r.metric: r.undefined for r in report_tables.comparison_table(v, v, d).collect()} == {"A (x)": 0, "aA": 9}
    assert report_tables.partially_undefined(d).count() == 0
    assert [tuple(r) for r in report_tables.partially_undefined(d.withColumn("undefined", F.lit(2).cast("long"))).collect()] == [("A (x)", 2)]
    lines = report_tables.markdown(v.withColumn("metric", F.concat("metric", F.lit("|"))), ["value"]).orderBy("place").collect()
    assert [r.line for r in lines] == ["| attribute | metric | value |", "| --- | --- | --- |", "|  | aA\\| | 0.2500 |", "| x | A\\| | 0.5000 |"]
    models = spark.createDataFrame([("m", "1", "a", "u"), ("m", "2", "b", "u")], "method string, model string, null_policy string, split_use string")
    with pytest.raises(Exception, match="differ"):
        report_tables.method_average_table(spark.createDataFrame([("m", "1", "aA", 1.0)], "method string, model string, metric string, value double"), models, None, ["aA"]).collect()


def test_selection_in_a_small_release(spark):
    splits = spark.createDataFrame([("val", i, s) for i, s in enumerate("abcdefg")] + [("unlabeled_x", 0, "h"), ("val", 9, "z")], "split string, place int, segment_id string")
    images = spark.createDataFrame([(s, f"2{s}") for s in "abcdegh"] + [("a", "1a"), ("b", None)], "segment_id string, path string")
    labels = spark.createDataFrame([(s, "x", 1) for s in "abcdefg"] + [(s, "y", 0) for s in "acdefg"] + [("a", "y", None), ("h", "x", 1)], "segment_id string, attribute string, class_idx int")
    roads = spark.createDataFrame([("r1", i, s) for i, s in enumerate("abcd")] + [("r2", i, s) for i, s in enumerate("cdefgh")], "road_id string, place int, segment_id string")
    args = (splits, images, labels, roads, ["x", "y"])
    steps = {r.segment_id: r.passed for r in selection.passed_steps(*args, selection.Preset((-1, 0))).collect()}
    # a and c begin their longest roads, b lacks a label, f and z have no image, g follows f, h has no labels but needs none.
    assert steps == {"a": 4, "b": 2, "c": 4, "d": 6, "e": 6, "f": 1, "g": 4, "h": 6, "z": 1}
    lenient = selection.passed_steps(*args, selection.Preset((0,), allow_missing=True, use_subset=True), splits.where("segment_id in ('b', 'c')"))
    assert {r.segment_id: (r.path, r.labels, r.road_id) for r in selection.selected(lenient).collect()} == {"b": ("2b", [1, None], "r1"), "c": ("2c", [1, 0], "r2"), "h": ("2h", [None, None], "r2")}
    assert selection.step_counts(lenient).where("split = 'val'").first().asDict() == {"split": "val", "listed": 8, "image": 6, "labels": 6, "road": 6, "context": 6, "subset": 2}
    with pytest.raises(ValueError, match="subset"):
        selection.passed_steps(*args, selection.Preset(use_subset=True))
