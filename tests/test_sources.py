"""Files are read as written, and damaged or odd ones give a defined result."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from tarmac.sources import predictions, spreadsheets, tracks


def _points(spark):
    rows = [("a", 0.0, 45.123456789, 16.5, 101.23456), ("a", 1.5, 45.2, 16.6, None), ("b", 1700000000.25, -1.0, 179.9999999, 0.0)]
    return spark.createDataFrame(rows, "track string, t double, lat double, lon double, ele double")


def test_gpx_round_trip(spark, tmp_path):
    tracks.write_lines(tracks.gpx_lines(_points(spark)), str(tmp_path / "gpx"))
    files = sorted((tmp_path / "gpx").rglob("*.txt"))
    assert len(files) == 2
    (tmp_path / "in").mkdir()
    for f in files:
        (tmp_path / "in" / f"{f.parent.name.removeprefix('track=')}.gpx").write_text(f.read_text())
    got = sorted(map(tuple, tracks.read_gpx(spark, str(tmp_path / "in")).select("track", "t", "lat", "lon", "ele").collect()))
    assert got == [("a", 0.0, 45.1234568, 16.5, 101.235), ("a", 1.5, 45.2, 16.6, None), ("b", 1700000000.25, -1.0, 179.9999999, 0.0)]


def test_gpx_skips_points_without_time_and_keeps_the_greatest_of_equal_times(spark, tmp_path):
    body = '<trkpt lat="1" lon="2"><ele>3</ele></trkpt><trkpt lat="1" lon="2"><ele>4</ele><time>2020-01-01T00:00:00Z</time></trkpt><trkpt lat="1" lon="3"><time>2020-01-01T00:00:00</time></trkpt><trkpt lat="1" lon="9"><time>soon</time></trkpt>'
    (tmp_path / "x.gpx").write_text(f'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>{body}</trkseg></trk></gpx>')
    assert [tuple(r) for r in tracks.read_gpx(spark, str(tmp_path / "x.gpx")).select("track", "t", "lat", "lon").collect()] == [("x", 1577836800.0, 1.0, 3.0)]


def _one_file(folder, track):
    return next((folder / f"track={track}").glob("*.txt")).read_text()


def test_webgis_and_geojson_are_json(spark, tmp_path):
    p = _points(spark).selectExpr("*", "0.5D as timeoffset")
    tracks.write_lines(tracks.webgis_lines(p), str(tmp_path / "w"))
    assert json.loads(_one_file(tmp_path / "w", "a")) == [{"timeoffset": 0.5}, {"time": 0.0, "coordinates": [16.5, 45.123456789]}, {"time": 1.5, "coordinates": [16.6, 45.2]}]
    (tmp_path / "a.json").write_text(_one_file(tmp_path / "w", "a"))
    got = sorted(map(tuple, tracks.read_webgis(spark, str(tmp_path / "a.json")).collect()))
    assert got == [("a", 0.5, 0.0, 45.123456789, 16.5), ("a", 0.5, 1.5, 45.2, 16.6)]
    tracks.write_lines(tracks.geojson_lines(p), str(tmp_path / "g"))
    feature = json.loads(_one_file(tmp_path / "g", "a"))["features"][0]
    assert feature["properties"] == {"FILENAME": "a.mp4"} and feature["geometry"]["coordinates"] == [[16.5, 45.123456789], [16.6, 45.2]]


def test_insert_round_trip(spark, tmp_path):
    p = _points(spark).selectExpr("*", "'2020-01-01' as recording_start", "'me' as uploaded_by", "'7' as gis_map_id")
    tracks.write_lines(tracks.insert_lines(p, "s.logs"), str(tmp_path / "i"))
    text = _one_file(tmp_path / "i", "a")
    assert text.startswith("INSERT INTO s.logs(filename") and text.rstrip().endswith(")',3857));")
    (tmp_path / "a.sql").write_text(text)
    assert tuple(tracks.read_insert(spark, str(tmp_path / "a.sql"), "other").first()) == ("a", "s.logs", "a", "2020-01-01", "me", "7")
    (tmp_path / "b.sql").write_text("nothing")
    assert tuple(tracks.read_insert(spark, str(tmp_path / "b.sql"), "other").first())[1:3] == ("other", None)


def test_cut_list(spark):
    lines = spark.createDataFrame([("v1  1:00\t30 bad",), ("v1 0:30",), ("v2",), ("   ",), (None,)], "value string")
    got = {r["stem"]: (r["cuts"], r["bad"]) for r in tracks.cut_list(lines).collect()}
    assert got == {"v1": ([30.0, 60.0], ["bad"]), "v2": ([], [])}


def test_predictions_round_trip_with_header(spark, tmp_path):
    wide = spark.createDataFrame([("1", [0.25, 0.75], 3), ("2", None, None)], "segment_id string, soft array<float>, hard int")
    predictions.write_predictions(wide, str(tmp_path / "p"), {"method": "m", "seed": 1})
    assert predictions.read_header(spark, str(tmp_path / "p")) == {"method": "m", "seed": 1}
    got = sorted((r["segment_id"], r["attribute"], r["probs"], r["pred"]) for r in predictions.read_predictions(spark, str(tmp_path / "p"), classes={"soft": 2}).collect())
    assert got == [("1", "hard", None, 3), ("1", "soft", [0.25, 0.75], None), ("2", "hard", None, None), ("2", "soft", None, None)]
    with pytest.raises(PySparkException):
        predictions.read_predictions(spark, str(tmp_path / "p"), classes={"soft": 3}).collect()
    with pytest.raises(TypeError):
        predictions.to_long(spark.range(1).selectExpr("'1' as segment_id", "'x' as bad"))


def _workbook(path, sheets, strings):
    main, links = spreadsheets.MAIN.strip("{}"), spreadsheets.LINKS.strip("{}")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>' + "".join(f'<sheet name="s{i}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for i, body in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_first_sheet_with_rows(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"></row><row r="3"><c r="A3"><v>12</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row>'
    _workbook(tmp_path / "t.xlsx", ["", rows], ["Section ", "Code"])
    (tmp_path / "~$t.xlsx").write_bytes(b"lock")
    sheets = spreadsheets.read_sheets(spark, str(tmp_path))
    assert [(r["row"], r["cells"]) for r in sheets.orderBy("row").collect()] == [(0, ["Section ", None, "Code"]), (1, ["12", None, "x"])]
    assert [tuple(r)[1:] for r in spreadsheets.with_header(sheets, ["section", "CODE", "none"]).collect()] == [(1, "12", "x", None)]


def test_workbooks_in_zip_files(spark, tmp_path):
    row = '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
    for name in ("one", "two", "~$two"):
        _workbook(tmp_path / f"{name}.xlsx", [row], [name])
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for name, to in (("one", "b/one"), ("two", "a/two"), ("~$two", "a/~$two")):
            z.write(tmp_path / f"{name}.xlsx", f"{to}.xlsx")
        z.writestr("notes.txt", "no workbook")
    (tmp_path / "two.xlsx").unlink()
    found = {r.path.rpartition("/")[2] if "!" not in r.path else r.path.partition("!")[2]: r["cells"] for r in spreadsheets.read_sheets(spark, str(tmp_path)).collect()}
    assert found == {"one.xlsx": ["one"], "/b/one.xlsx": ["one"], "/a/two.xlsx": ["two"]}


def test_insert_columns_by_name(spark, tmp_path):
    (tmp_path / "c.sql").write_text("insert  into Public.Logs (GIS_MAP_ID, the_geom,\n uploaded_by, filename) values ( 12, ST_GeomFromText('LINESTRING(1 2,3 4)', 3857), 'O''Neill, (x)', NULL);")
    long = ",".join(["1.5 2.5"] * 100_000)
    (tmp_path / "d.sql").write_text(f"INSERT INTO logs VALUES ('f', 'r', 'u''', '9', ST_GeomFromText('LINESTRING({long})', 3857))")
    (tmp_path / "e.sql").write_text("SELECT 1")
    rows = {r.track: tuple(r)[1:] for r in tracks.read_insert(spark, [str(tmp_path / f) for f in ("c.sql", "d.sql", "e.sql")], "other").collect()}
    assert rows["c"] == ("Public.Logs", None, None, "O'Neill, (x)", "12")
    assert rows["d"] == ("other", "f", "r", "u'", "9")
    assert rows["e"] == ("other", None, None, None, None)
