"""Sheets with odd headers and cells, copies and reports, against what each row is meant to be."""

from __future__ import annotations

import json

import pytest

from tarmac.operators import coding_tables as ct

HEAD = ["section", " Distance", "Length", "Latitude start", "Longitude start", "Image Reference FPZ", "Comments", "Surface", "lanes", "Road traffic"]


@pytest.fixture(scope="module")
def schema(spark):
    words = [("Surface", 0, c) for c in (1, 2, 3)] + [("Lanes", 1, c) for c in (1, 2)] + [(ct.VOLUME[0], 2, c) for c in range(1, 8)] + [("Gone", 3, 1)]
    return ct.attribute_schema(spark.createDataFrame(words, "attribute string, place int, code int"), ["Gone"], {ct.VOLUME[0]: "road traffic"})


def row(seg="Seg. No. 0012 x", length="0.02", section="A ", surface="1.0", lanes="2 both", volume="1500", more=()):
    return [section, "1.5", length, "10", "20.25", seg, None, surface, lanes, volume, *more]


def sheets(spark, files):
    rows = [(f, i, cells) for f, lines in files.items() for i, cells in enumerate(lines)]
    return spark.createDataFrame(rows, "path string, row long, cells array<string>")


def test_reasons_in_order(spark, schema):
    lines = [
        (row(), None),
        ([None, " ", "", "nan", None, "", "  ", "1", "1", "1"], "padding"),
        (row(more=["5.0"]), None),
        (row(length="9", more=["5.1"]), "annot_loc_offset_too_far"),
        (row(length="0.020002"), "length_mismatch"),
        (row(length=None), "length_mismatch"),
        (row(length="0.0200005", section=" "), "missing_scalar"),
        (row(seg="see 123"), "bad_seg_id"),
        (row(seg="frame 12345 of"), None),
        (row(surface="9", lanes="7"), "unknown_code"),
        (row(surface=None, lanes="2.5", volume=""), "no_attributes"),
        (row(volume="0"), None),
        ([], "padding"),
    ]
    made = {r.row: r for r in ct.parse(sheets(spark, {"f": [[*HEAD, "Offset_distance_M"], *[r for r, _ in lines]]}), schema).collect()}
    assert [made[i + 1].drop_reason for i in range(len(lines))] == [want for _, want in lines]
    assert made[1].segment == "12" and made[1].section == "A" and made[1].comments == "" and made[9].segment == "12345"
    assert made[1].codes == {"Surface": 1, "Lanes": 2, ct.VOLUME[0]: 4} and made[12].codes[ct.VOLUME[0]] == 7
    assert (made[10].bad_attribute, made[10].bad_code) == ("Surface", 9)
    assert made[11].filled == 0 and made[11].given == ["Lanes"]


def test_missing_attributes_drop_rows_if_asked(spark, schema):
    rows = sheets(spark, {"f": [HEAD, row(lanes=None, volume="x"), row(surface=None, lanes="9"), row(surface="9", lanes=None), row()]})
    made = {r.row: (r.drop_reason, r.bad_attribute, r.bad_code) for r in ct.parse(rows, schema, ct.Rules(drop_missing=True)).collect()}
    assert made == {1: ("missing_attribute", "Lanes", None), 2: ("missing_attribute", "Surface", None), 3: ("unknown_code", "Surface", 9), 4: (None, None, None)}
    made = {r.row: r.codes for r in ct.parse(rows, schema).where("drop_reason is null").collect()}
    assert made[1] == {"Surface": 1, "Lanes": -1, ct.VOLUME[0]: -1}


def test_states_of_files(spark, schema):
    files = {"good": [HEAD, row()], "notes": [["Section", "what"], ["1", "2"]], "short": [[h for h in HEAD if h != "Length"] + ["Lengths"]], "blank": [[None, " "]], "empty": [HEAD]}
    made = {r.file: (r.status, r.missing) for r in ct.file_states(sheets(spark, files), schema).collect()}
    assert made == {"good": ("processed", []), "notes": ("skipped", []), "short": ("columns", ["Length -> Lengths"]), "blank": ("skipped", []), "empty": ("processed", [])}
    assert {r.file for r in ct.parse(sheets(spark, files), schema).collect()} == {"good"}


def test_copies(spark, schema):
    a = [HEAD, row(seg="seg no 1", lanes=None), row(seg="seg no 2"), row(seg="seg no 3")]
    b = [HEAD, row(seg="seg no 1", surface="2"), row(seg="seg no 2", surface="3"), row(seg="seg no 2", surface="9")]
    parsed = ct.parse(sheets(spark, {"b": b, "a": a}), schema)
    kept = {r.segment: (r.file, r.row, r.copies) for r in ct.kept_rows(parsed).collect()}
    assert kept == {"1": ("b", 1, 2), "2": ("a", 2, 2), "3": ("a", 3, 1)}
    assert {tuple(r) for r in ct.duplicates(parsed).collect()} == {("1", 2, "b", 1, 3, 2, "most filled"), ("2", 2, "a", 2, 3, 3, "first")}
    assert {(r.segment, r.attribute, tuple(r.codes)) for r in ct.conflicts(parsed).collect()} == {("1", "Surface", (1, 2)), ("2", "Surface", (1, 3))}


def test_one_segment_of_most_rows_is_reduced_first(spark, schema):
    parsed = ct.parse(sheets(spark, {"f": [HEAD, *[row(seg="seg no 1") for _ in range(300)], row(seg="seg no 2")]}), schema)
    assert {(r.segment, r.copies, r.row) for r in ct.kept_rows(parsed).collect()} == {("1", 300, 1), ("2", 1, 301)}
    plan = ct.kept_rows(parsed)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_reports_and_files(spark, schema, tmp_path):
    files = {
        "a": [HEAD, row(seg="seg no 1", lanes=None), row(seg="seg no 2", lanes=None), row(seg="none", lanes=" "), row(surface="8", lanes=None), [None] * 7 + ["1"]],
        "b": [HEAD, row(seg="seg no 1"), row(seg="seg no 4", volume=None, section="B")],
        "c": [["x"], ["y"]],
    }
    ct.write_parse(sheets(spark, files), schema, str(tmp_path))
    rows = {r.segment: r for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert sorted(rows) == ["1", "2", "4"] and rows["2"]["Lanes"] == -1 and rows["1"]["source_file"] == "b"

    def lines(name, key):
        return {r[key]: r for f in (tmp_path / "report" / name).glob("*.json") for r in map(json.loads, f.read_text().splitlines())}

    reports = lines("files", "file")
    assert reports["a"] == {"file": "a", "status": "processed", "missing": [], "rows_non_empty": 5, "rows_kept": 2, "rows_with_missing": 2, "dropped": {"bad_seg_id": 1, "unknown_code": 1}, "empty": ["Lanes"], "missing_values": {"Lanes": 2}}
    assert reports["b"]["rows_with_missing"] == 1 and reports["b"]["missing_values"] == {ct.VOLUME[0]: 1} and "dropped" not in reports["b"]
    assert reports["c"] == {"file": "c", "status": "skipped", "missing": []}
    assert lines("attributes", "attribute") == {
        "Surface": {"attribute": "Surface", "files_empty": 0, "rows_missing": 0, "unknown_codes": 1},
        "Lanes": {"attribute": "Lanes", "files_empty": 1, "rows_missing": 1, "unknown_codes": 0},
        ct.VOLUME[0]: {"attribute": ct.VOLUME[0], "files_empty": 0, "rows_missing": 1, "unknown_codes": 0},
    }
    assert lines("summary", "files") == {3: {"files": 3, "files_processed": 2, "files_skipped": 1, "rows_dropped": 2, "rows_kept": 3, "rows_with_missing": 2, "dropped_copies": 1, "sections": 2}}
    with pytest.raises(ValueError, match="Comments"):
        ct.write_parse(sheets(spark, {"f": [[h for h in HEAD if h != "Comments"]]}), schema, str(tmp_path / "none"))


def test_no_files(spark, schema):
    none = sheets(spark, {"f": [HEAD]}).where("false")
    parsed = ct.parse(none, schema)
    assert parsed.count() == 0 and ct.file_states(none, schema).count() == 0
    assert ct.summary(ct.file_states(none, schema), parsed, ct.kept_rows(parsed)).first().rows_kept == 0
