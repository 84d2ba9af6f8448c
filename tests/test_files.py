"""Listings and prediction files: what other writers wrote, and what others read of ours."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tarmac.sources import files

KEY = "road_predictions"
HEADER = {"format_version": 1, "dataset": "d", "split": "val", "classes": {"surface": [1, 2], "curve": [1, 2, 3]}}


def foreign(path, key=KEY, header=HEADER, **columns):
    made = {"segment_id": pa.array(["7", "5", "6"]), "surface": pa.array([[0.25, 0.75], None, [1.0, 0.0]], pa.large_list(pa.float32())), "curve": pa.nulls(3, pa.null())} | columns
    pq.write_table(pa.table(made).replace_schema_metadata({key: json.dumps(header, ensure_ascii=False), "other": "x"}), path)


def test_files_of_another_writer(spark, tmp_path):
    foreign(tmp_path / "a.parquet", curve=pa.array([[0.0, 0.5, 0.5]] * 3, pa.list_(pa.float64())))
    foreign(tmp_path / "b.parquet", header=HEADER | {"dataset": "é"}, surface=pa.array([1, None, 0], pa.int8()), curve=pa.array([2, 1, 0]))
    rows = {(r.file, r.segment_id, r.attribute): (r.probs, r.pred) for r in files.read_prediction_files(spark, str(tmp_path), codesField="classes").collect()}
    assert len(rows) == 12 and rows["a.parquet", "7", "surface"] == ([0.25, 0.75], None) and rows["a.parquet", "5", "surface"] == (None, None)
    assert rows["b.parquet", "7", "surface"] == (None, 1) and rows["b.parquet", "5", "surface"] == (None, None) and rows["b.parquet", "7", "curve"] == (None, 2)
    heads = {r.file: json.loads(r.header)["dataset"] for r in files.read_prediction_files(spark, str(tmp_path), header_only=True, headerKey=KEY).collect()}
    assert heads == {"a.parquet": "d", "b.parquet": "é"}
    one = files.read_prediction_files(spark, f"file://{tmp_path}/b.parquet")
    assert one.count() == 6


def test_a_header_is_read_without_columns(spark, tmp_path):
    """Bytes of the columns may be spoilt, as only the footer is read."""
    foreign(tmp_path / "a.parquet", curve=pa.array([[0.0, 0.5, 0.5]] * 3))
    data = bytearray((tmp_path / "a.parquet").read_bytes())
    start = pq.ParquetFile(tmp_path / "a.parquet").metadata.row_group(0).column(0).dictionary_page_offset or 4
    data[start : start + 40] = bytes(40)
    (tmp_path / "a.parquet").write_bytes(bytes(data))
    assert files.read_prediction_files(spark, str(tmp_path), header_only=True).count() == 1


@pytest.mark.parametrize(("columns", "error"), [({"extra": pa.array([1, 2, 3])}, "not those of the header"), ({"surface": pa.array([[1.0]] * 3)}, "for 2 classes"), ({"surface": pa.array(["x", "y", "z"])}, "no prediction")])
def test_bad_columns(spark, tmp_path, columns, error):
    foreign(tmp_path / "a.parquet", **columns)
    with pytest.raises(Exception, match=error):
        files.read_prediction_files(spark, str(tmp_path), codesField="classes").collect()


def test_bad_headers(spark, tmp_path):
    foreign(tmp_path / "a.parquet", key="something")
    with pytest.raises(Exception, match="0 headers"):
        files.read_prediction_files(spark, str(tmp_path)).collect()
    foreign(tmp_path / "a.parquet", header=[1])
    with pytest.raises(Exception, match="no JSON object"):
        files.read_prediction_files(spark, str(tmp_path), header_only=True).collect()


def wide(spark):
    rows = spark.range(50).select(F.concat(F.lit("m"), F.col("id") % 3, F.lit(".parquet")).alias("file"), F.col("id").alias("segment_id"))
    return rows.withColumn("surface", F.when(F.col("segment_id") % 7 > 0, (F.col("segment_id") % 2).cast("int"))).withColumn("curve", F.lit(1))


def headers(spark, n=3):
    return spark.createDataFrame([(f"m{i}.parquet", json.dumps({"model": i})) for i in range(n)], "file string, header string")


def test_round_trip(spark, tmp_path):
    files.write_prediction_files(wide(spark), headers(spark), str(tmp_path), headerKey=KEY)
    assert sorted(os.listdir(tmp_path)) == ["m0.parquet", "m1.parquet", "m2.parquet"]
    table = pq.read_table(tmp_path / "m1.parquet")
    assert json.loads(pq.ParquetFile(tmp_path / "m1.parquet").metadata.metadata[KEY.encode()]) == {"model": 1}
    assert table.column_names == ["segment_id", "surface", "curve"] and table.num_rows == 17
    back = files.read_prediction_files(spark, str(tmp_path)).where("attribute = 'surface'")
    want = wide(spark).select("file", F.col("segment_id").cast("string"), "surface")
    assert sorted(map(tuple, back.select("file", "segment_id", "pred").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_nothing_appears_of_what_fails(spark, tmp_path):
    """A missing header, or names that are there already, leave the folder as it was."""
    with pytest.raises(Exception, match="no header"):
        files.write_prediction_files(wide(spark), headers(spark, 2), str(tmp_path))
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == []
    foreign(tmp_path / "m2.parquet")
    before = (tmp_path / "m2.parquet").read_bytes()
    with pytest.raises(Exception, match="clash"):
        files.write_prediction_files(wide(spark), headers(spark), str(tmp_path))
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["m2.parquet"] and (tmp_path / "m2.parquet").read_bytes() == before


def test_listing_of_many_files(spark, tmp_path):
    """10,000 files in 50 folders of two levels, none of which can be opened."""
    for i in range(50):
        folder = tmp_path / f"r{i % 5}" / f"v{i}"
        folder.mkdir(parents=True)
        for j in range(200):
            os.close(os.open(folder / f"x_{j}_seg{i * 200 + j:06}.png", os.O_CREAT, 0))
    (tmp_path / "top_seg7.PNG").touch()
    (tmp_path / "r0" / "notes.txt").write_text("12345")
    for levels in (0, 1, 2, 3):
        listed = files.list_files(spark, str(tmp_path), levels)
        assert listed.count() == listed.select("path").distinct().count() == 10_002
    images = {r.segment_id: r.paths for r in files.images_by_segment(files.list_files(spark, str(tmp_path))).collect()}
    assert len(images) == 10_000 and images["7"] == ["r0/v0/x_7_seg000007.png", "top_seg7.PNG"] and images["0"] == ["r0/v0/x_0_seg000000.png"]
    assert files.list_files(spark, str(tmp_path)).where("name = 'notes.txt'").first().size == 5
    with pytest.raises(Exception, match="(?i)not"):
        files.list_files(spark, str(tmp_path / "none")).count()


def test_stems(spark, tmp_path):
    for name in ("a.mp4", "a.txt", "b.txt", "c.MP4", "d/c.mov", "e.txt", "d/e.csv", ".hidden", "noext", "f.mp4", "d/f.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    listed = files.list_files(spark, str(tmp_path))

    def stems(**options):
        return {r.stem: r.path or r.error for r in files.by_stem(listed, **options).collect()}

    assert stems(extensions=[".mp4"]) == {"a": "a.mp4", "c": "c.MP4", "f": "duplicate"}
    assert stems(preferred=[".mp4"]) == {"a": "a.mp4", "b": "b.txt", "c": "c.MP4", "e": "duplicate", ".hidden": ".hidden", "noext": "noext", "f": "duplicate"}
    assert stems()["a"] == "duplicate" and stems()["b"] == "b.txt"
