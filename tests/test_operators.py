"""Small cases with known values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tarmac.functions import arrays, codes, geo
from tarmac.operators import annotations, archive, ensembles, roads, scoring, tracks


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def _cells(spark, matrix):
    data = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    return spark.createDataFrame(data, "label int, pred int, n long").withColumn("attribute", F.lit("a"))


def test_class_metrics_of_a_known_matrix(spark):
    got = {r["class"]: r for r in scoring.class_metrics(_cells(spark, [[3, 1, 0], [2, 4, 0], [0, 0, 0]]), ["attribute"]).collect()}
    assert set(got) == {0, 1}
    assert (got[0]["precision"], got[1]["precision"]) == (0.6, 0.8)
    m = scoring.attribute_metrics(scoring.class_metrics(_cells(spark, [[3, 1, 0], [2, 4, 0], [0, 0, 0]]), ["attribute"]), ["attribute"]).first()
    assert m["accuracy"] == pytest.approx(0.7) and m["n"] == 10


def test_undefined_metrics_are_null(spark):
    m = scoring.attribute_metrics(scoring.class_metrics(_cells(spark, [[5]]), ["attribute"]), ["attribute"]).first()
    assert m["mcc"] is None and m["kappa"] is None and m["accuracy"] == 1.0


def test_infinite_nll_is_kept(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (0, None)], "label int, probs array<double>").withColumn("attribute", F.lit("a"))
    got = {r["label"]: r for r in scoring.probability_sums(df, ["attribute"]).collect()}
    assert got[0]["nll"] == pytest.approx(math.log(2)) and got[1]["nll"] == math.inf and got[0]["support"] == 1


def test_null_policies(spark):
    df = spark.createDataFrame([(1, None), (1, 1)], "label int, pred int")
    assert {r["pred"] for r in scoring.apply_null_policy(df, "first_class").collect()} == {0, 1}
    assert scoring.apply_null_policy(df, "exclude").count() == 1
    with pytest.raises(ValueError):
        scoring.apply_null_policy(df, "other")


def test_percentiles_with_infinities(spark):
    df = spark.createDataFrame([("a", float("inf"))] * 3 + [("a", 1.0), ("a", None)], "k string, value double")
    r = scoring.percentile_interval(df, ["k"]).first()
    assert r["undefined"] == 1 and r["high"] == math.inf


def test_paired_difference_of_infinities_is_null(spark):
    inf = spark.createDataFrame([(0, float("inf"))], "resample int, value double")
    assert scoring.paired_differences(inf, inf, ["resample"]).first()["difference"] is None


def test_softmax_and_argmax(spark):
    p = _one(spark, arrays.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    assert _one(spark, arrays.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))) == 1
    assert _one(spark, arrays.argmax(F.lit(None).cast("array<double>"))) is None
    assert _one(spark, arrays.one_hot(F.lit(1), 3)) == [0.0, 1.0, 0.0]
    assert _one(spark, arrays.is_distribution(F.array(F.lit(0.5), F.lit(0.6)), 2)) is False
    assert _one(spark, arrays.reorder(F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(10), F.lit(20)), F.array(F.lit(20), F.lit(10), F.lit(5)))) == [0.9, 0.1, None]


def test_ensemble_of_two_members(spark):
    df = spark.createDataFrame([("s1", 1.0, [0.2, 0.8]), ("s1", 3.0, [0.6, 0.4]), ("s2", 1.0, [0.6, 0.4]), ("s2", 3.0, None), ("s3", 1.0, None)], "segment string, weight double, probs array<double>")
    got = {r["segment"]: r["probs"] for r in ensembles.weighted_mean(df, ["segment"]).collect()}
    assert got["s1"] == pytest.approx([0.5, 0.5]) and got["s2"] == pytest.approx([0.6, 0.4]) and got["s3"] is None


@pytest.mark.parametrize(
    ("cell", "lenient", "strict"), [("3", 3, 3), ("3.0", 3, None), ("3 text", 3, None), ("2.5", None, None), ("None", None, None), ("-4", -4, None), ("", None, None), (None, None, None)]
)
def test_codes(spark, cell, lenient, strict):
    c = F.lit(cell).cast("string")
    assert _one(spark, codes.lenient_int(c)) == lenient
    assert _one(spark, codes.code(c)) == strict


def test_timecodes_and_buckets(spark):
    assert _one(spark, codes.timecode(F.lit("1:02:03"))) == 3723.0
    assert _one(spark, codes.timecode(F.lit("x"))) is None
    assert [_one(spark, codes.bucket(F.lit(v).cast("double"), [15000, 10000])) for v in (20000, 10000, 1, None)] == [1, 2, 3, None]


def test_interpolation_between_located_segments(spark):
    data = [(0, None, None), (1, 0.0, 0.0), (2, None, None), (3, None, None), (4, 3.0, 6.0), (5, None, None), (6, None, None), (7, 6.0, 3.0)]
    df = spark.createDataFrame(data, "position int, lon double, lat double").withColumn("road", F.lit("r"))
    got = {r["position"]: (r["lon"], r["lat"]) for r in roads.interpolate(df, "road", "position", ["lon", "lat"]).collect()}
    assert got[0] == (None, None) and got[2] == pytest.approx((1, 2)) and got[3] == pytest.approx((2, 4)) and got[6] == pytest.approx((5, 4))


def test_context_at_road_ends(spark):
    df = spark.createDataFrame([("r", i, f"S{i}") for i in range(4)], "road string, position int, segment string")
    got = roads.complete_context(df, "road", "position", "segment", (0, -1), F.col("segment") != "S2").collect()
    assert {r["segment"]: r["context"] for r in got} == {"S1": ["S1", "S0"]}


def test_ranges(spark):
    df = spark.createDataFrame([("a", i) for i in (92, 93, 468, 469, 470, 7)], "g string, i int")
    assert roads.id_ranges(df, "g", "i").first()["ranges"] == "7, 92-93, 468-470"


def test_kappa_of_one_code_is_null(spark):
    pairs = spark.createDataFrame([(0, 1, 3, 3, 5)], "a int, b int, code_a int, code_b int, n long")
    r = annotations.kappa(pairs, ["a", "b"]).first()
    assert r["agreement"] == 1.0 and r["kappa"] is None


def test_cut_points(spark):
    df = spark.createDataFrame([("v", 0.0, 10.0), ("v", 4.0, 10.0), ("v", 4.0, 10.0), ("v", 12.0, 10.0)], "v string, t double, d double")
    got = [(r["start_s"], r["end_s"]) for r in tracks.cuts_to_segments(df, "v", "t", "d").orderBy("cut_no").collect()]
    assert got == [(0.0, 4.0), (4.0, 10.0)]


def test_track_values_are_clamped(spark):
    p = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "track string, t double, v double")
    q = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 9.0)], "track string, t double")
    assert [r["v"] for r in tracks.at_times(p, q, "track", "t", ["v"]).orderBy("t").collect()] == [10.0, 20.0, 30.0]


def test_geometry(spark):
    assert _one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * geo.MEAN_RADIUS)
    assert _one(spark, geo.initial_bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0))) == pytest.approx(270)


def test_ranking_and_highlights(spark):
    df = spark.createDataFrame([("a", 1.0, "m"), ("b", None, "m"), ("c", 3.0, "m")], "name string, v double, m string")
    assert [r["name"] for r in archive.rank(df, F.col("v"), "name").orderBy("rank").collect()] == ["c", "a", "b"]
    assert {r["name"]: r["strength"] for r in archive.highlight(df, "m", "v").collect()} == {"a": 0.0, "b": None, "c": 1.0}


def test_stream_counts_each_batch_once(spark, tmp_path):
    from tarmac.streaming import scoring as stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", None, 1)], "attribute string, label int, pred int").write.parquet(src)

    def run():
        df = spark.readStream.schema("attribute string, label int, pred int").parquet(src)
        stream.count_stream(df, str(tmp_path / "cells"), str(tmp_path / "ck")).awaitTermination()
        return {(r["label"], r["pred"]): r["n"] for r in stream.cells(spark, str(tmp_path / "cells")).collect()}

    assert run() == run() == {(0, 0): 1, (0, 1): 1}
    spark.createDataFrame([("a", 0, 0)], "attribute string, label int, pred int").write.mode("append").parquet(src)
    assert run() == {(0, 0): 2, (0, 1): 1}


def test_long_roads_are_read_once(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("road"), F.col("id").alias("o"), F.when(F.col("id") % 50_000 == 0, F.col("id") * 2.0).alias("x"))
    made = {r["o"]: r["x"] for r in roads.interpolate(rows, "road", "o", ["x"]).where("o in (0, 1, 75000, 150000, 150001)").collect()}
    assert made == {0: 0.0, 1: 2.0, 75_000: 150_000.0, 150_000: 300_000.0, 150_001: None}
    later = roads.next_with(rows, "road", "o", "o", F.col("o") % 50_000 == 0)
    assert {r["o"]: r["next_id"] for r in later.where("o in (0, 49999, 150000)").collect()} == {0: 50_000, 49_999: 50_000, 150_000: None}
