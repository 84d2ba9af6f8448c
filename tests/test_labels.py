"""Vocabularies, ordinals and metadata folders on small and odd tables."""

from __future__ import annotations

import json

import pytest

from tarmac.operators import labels
from tarmac.sources import metadata


@pytest.mark.parametrize("cut", [(None, None, 1), (-3, None, 1), (2, -2, 2), (None, None, -2), (5, 1, -1), (50, None, 1), (None, -50, -1)])
def test_slices_are_those_of_python(spark, cut):
    rows = [7 * i % 23 for i in range(23)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "k long")
    assert sorted(r.k for r in labels.sliced(df, "k", *cut).collect()) == sorted(sorted(rows)[slice(*cut)])


def test_split_is_exact(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    assert sorted(r.k for r in labels.exact_split(df, "k", ratio=0.25).where("first").collect()) == [0, 1]
    assert sorted(r.k for r in labels.exact_split(df, "k", index=-3).where("not first").collect()) == [7, 8, 9]
    assert labels.exact_split(df.limit(0), "k", ratio=0.5).count() == 0
    with pytest.raises(ValueError):
        labels.exact_split(df, "k")


def test_restricted_needs_known_attributes(spark):
    vocab = labels.vocabulary(spark, {"a": {"x": 1}, "b": {"y": 2}})
    assert [tuple(r) for r in labels.restricted(vocab, ["b"]).collect()] == [("b", 0, 0, 2, "y")]
    with pytest.raises(ValueError, match="c"):
        labels.restricted(vocab, ["a", "c"])


def test_metadata_folder(spark, tmp_path):
    files = {
        "attribute_metadata.json": {"attribute_to_idx": {"width": 1, "area": 0}, "attribute_value_to_irap_number": {"width": {"wide": 3, "narrow": 1}, "area": {"town": 2}}},
        "splits.json": {"train": ["s2", "s1"], "unlabeled": []},
        "segment_id_to_data_paths_rel.json": {"s1": {"image": "a/s1.jpg"}},
        "segment_id_to_road_data.json": {"s1": {"lat": 1.5, "required_attributes": {"width": 3}}},
    }
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    got = metadata.read_metadata(spark, str(tmp_path))
    assert [tuple(r) for r in got["vocabulary"].orderBy("place", "class_idx").collect()] == [("area", 0, 0, 2, "town"), ("width", 1, 0, 3, "wide"), ("width", 1, 1, 1, "narrow")]
    assert [(r.place, r.key, r.value) for r in got["splits"].collect()] == [(0, "train", ["s2", "s1"]), (1, "unlabeled", [])]
    assert json.loads(got["road_data"].first().value)["required_attributes"] == {"width": 3}
    assert got["data_paths"].first().value == {"image": "a/s1.jpg"}
    assert got["roads"].count() == 0
    metadata.write_object(got["splits"], str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out").glob("part*")).read_text()) == files["splits.json"]


def test_nested_entries_survive_a_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": {"z": 1, "t": "x\\"y"}, "b": [1, {"c": null}], "c": "text", "d": null, "é\\n": "[not json", "n": 1.5}', encoding="utf-8")
    first = metadata.read_object(spark, str(tmp_path / "in.json"))
    metadata.write_object(first, str(tmp_path / "out"))
    again = metadata.read_object(spark, str(tmp_path / "out"))
    assert again.orderBy("place").collect() == first.orderBy("place").collect()
    written = json.loads(next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8"))
    assert written["a"] == {"z": 1, "t": 'x"y'} and written["b"] == [1, {"c": None}] and written["c"] == "text" and written["d"] is None and written["é\n"] == "[not json"
