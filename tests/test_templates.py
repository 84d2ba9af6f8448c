"""Templates that hold together, tables they give, and predictions that don't fit."""

from __future__ import annotations

import json

import pytest

from tarmac.operators import templates

T = templates.Template(("id", "b", "c", "d"), {"segment_id": "id"}, {"x": "c", "y": "b"})


@pytest.mark.parametrize(
    ("columns", "fields", "attributes", "said"),
    [(("a", "a"), {}, {}, "twice"), (("a",), {"segment_id": "b"}, {}, "no such columns"), (("a",), {"segment_id": "a"}, {"x": "a"}, "filled twice"), (("a",), {"speed": "a"}, {}, "no such fields")],
)
def test_wrong_templates(columns, fields, attributes, said):
    with pytest.raises(ValueError, match=said):
        templates.Template(columns, fields, attributes)


def test_names(spark):
    assert templates.Template.read(json.dumps({"columns": T.columns, "fields": T.fields, "attributes": T.attributes})) == T
    assert T.unmapped(["z", "x", "w"]) == ["z", "w"] and T.unfilled(["x", "z"]) == ["b", "d"]
    codes = spark.createDataFrame([(1, "x", 1), (1, "z", 2), (2, "y", None)], "segment_id long, attribute string, code int")
    assert {tuple(r) for r in templates.coverage(T, codes).collect()} == {("z", "unmapped", 1), ("b", "unfilled", 0), ("d", "unfilled", 0)}


def test_fill(spark):
    segments = spark.createDataFrame([(1, "r", 0), (2, "r", 1), (3, "q", 0)], "segment_id long, road_id string, place int")
    codes = spark.createDataFrame([(1, "x", 3), (1, "x", 2), (1, "y", 7), (2, "z", 1), (9, "x", 1)], "segment_id long, attribute string, code int")
    made = templates.fill(T, segments, codes)
    assert made.columns == ["road_id", "place", "id", "b", "c", "d"]
    assert sorted(map(tuple, made.collect())) == [("q", 0, "3", None, None, None), ("r", 0, "1", "7", "2", None), ("r", 1, "2", None, None, None)]
    assert templates.fill(T, segments, codes.limit(0)).count() == 3 and templates.fill(T, segments.limit(0), codes).count() == 0


def test_misfits(spark):
    words = spark.createDataFrame([("x", 1), ("x", 2)], "attribute string, code int")
    members = spark.createDataFrame([("test", 1), ("test", 2), ("val", 3)], "split string, segment_id long")
    rows = [("good", "test", 1, "x", 1), ("good", "test", 2, "x", None), ("less", "test", 1, "x", 2), ("more", "val", 3, "x", 1), ("more", "val", 4, "x", 1), ("odd", "new", 1, "x", 1), ("odd", "test", 1, "q", 1), ("odd", "test", 2, "x", 5)]
    predictions = spark.createDataFrame(rows, "model string, split string, segment_id long, attribute string, code int")
    made = {tuple(r) for r in templates.misfits(predictions, words, members).collect()}
    assert made == {("less", "missing", "test", 1), ("more", "segments", "val", 1), ("odd", "split", "new", 1), ("odd", "attribute", "q", 1), ("odd", "code", "x", 1)}
    assert templates.misfits(predictions.limit(0), words, members).count() == 0
