"""Evaluation sets and metrics by name: plans, policies, fingerprints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarmac.operators import evaluation_sets, metric_registry
from tarmac.plans import evaluation_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_needed_statistics(spark):
    rows = spark.createDataFrame([("x", 1, 1, [0.5, 0.5])], "attribute string, label int, pred int, probs array<double>")
    few, all_ = (plan(metric_registry.metrics(rows, [], names)) for names in (["amF1"], ["amF1", "aNLL"]))
    assert "nll#" not in few and "aggregate(" not in few and "nll#" in all_
    for bad in (["mf1"], ["A_supp3"], ["cNLL"], []):
        with pytest.raises(ValueError):
            metric_registry.metrics(rows, [], bad)
    assert len(set(metric_registry.protocol("soft"))) == 24 and set(metric_registry.protocol("hard")) < set(metric_registry.protocol("soft"))
    assert metric_registry.metrics(rows, [], metric_registry.protocol("soft")).count() == 24


def test_an_impossible_label_has_infinite_nll(spark):
    rows = spark.createDataFrame([("x", 1, 0, [1.0, 0.0]), ("x", 0, 0, None), ("x", None, 0, [1.0, 0.0])], "attribute string, label int, pred int, probs array<double>")
    assert metric_registry.metrics(rows, [], ["NLL"]).first().value == float("inf")


def test_results_of_other_metrics_are_not_aligned(spark):
    a = spark.createDataFrame([("x", "A", 1.0), (None, "aA", None)], "attribute string, metric string, value double")
    assert {r.metric: r.value for r in metric_registry.aligned(a, a, [], lambda x, y: x - y).collect()} == {"A": 0.0, "aA": None}
    with pytest.raises(Exception, match="different metrics"):
        metric_registry.aligned(a, a.where("metric = 'A'"), [], lambda x, y: x - y).collect()


def test_predictions_are_scanned_once_for_all_sets(spark, tmp_path):
    evaluation_queries._submissions(spark, SF).write.parquet(str(tmp_path / "predictions"))
    stored = spark.read.parquet(str(tmp_path / "predictions"))
    labels = evaluation_sets.with_sets(evaluation_queries.predictions(spark, SF).select("segment_id", "attribute", "label"), {k: F.expr(v) for k, v in evaluation_queries._SET_SQL.items()})
    met = stored.join(labels, ["segment_id", "attribute"])
    cells = evaluation_sets.by_set(metric_registry.cells(met, ["submission", "sets"], ["A"]), list(evaluation_queries._SET_SQL), ["submission", "attribute", "label", "pred"], ["n"])
    assert cells._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<submission") == 1


def test_policies(spark):
    labels = spark.createDataFrame([(i, "x", i % 2, 1) for i in range(4)] + [(9, "x", None, 1), (5, "y", 1, 1)], "segment_id long, attribute string, label int, sets long")
    pred = spark.createDataFrame([("s", i, "x", None) for i in range(4)] + [("s", 5, "z", 1)], "submission string, segment_id long, attribute string, pred int")

    def states(**policies):
        return {r.attribute: (r.labelled, r.invalid, r.missing, r.error) for r in evaluation_sets.score_sets(pred, labels, ["full"], ["x", "y"], ["A"], **policies)[1].collect()}

    assert states() == {"x": (4, 4, 0, None), "y": (1, 1, 0, "attribute")}
    assert states(missing_policy="invalid") == {"x": (4, 4, 0, None), "y": (1, 1, 0, None)}
    assert states(null_policy="exclude") == {"x": (4, 4, 0, "excluded"), "y": (1, 1, 0, "attribute")}
    scores = evaluation_sets.score_sets(pred, labels, ["full"], ["x", "y"], ["A"], missing_policy="invalid")[0]
    assert {r.attribute: r.value for r in scores.collect()} == {"x": 0.5, "y": 0.0}
    assert evaluation_sets.score_sets(pred, labels, ["full"], ["x", "y"], ["A"])[0].count() == 0
    for bad in ({"null_policy": "x"}, {"missing_policy": "x"}, {"metrics": ["NLL"]}):
        with pytest.raises(ValueError):
            evaluation_sets.score_sets(pred, labels, ["full"], ["x"], **bad)
    with pytest.raises(ValueError):
        evaluation_sets.with_sets(labels, {str(i): F.lit(True) for i in range(63)})


def test_fingerprints_follow_order_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(evaluation_sets, "RANGE", 4)
    rows = spark.range(100).select(F.col("id").alias("at"), (F.col("id") * 7 % 13).alias("v"), F.lit(None).cast("string").alias("w"))
    first = evaluation_sets.fingerprint(rows, "at", ["v", "w"])
    assert first == evaluation_sets.fingerprint(rows.repartition(64), "at", ["v", "w"]) == evaluation_sets.fingerprint(rows.coalesce(1), "at", ["v", "w"])
    swapped = rows.withColumn("at", F.when(F.col("at") == 3, 4).when(F.col("at") == 4, 3).otherwise(F.col("at")))
    others = {evaluation_sets.fingerprint(df, "at", ["v", "w"]) for df in (swapped, rows.where("at < 99"), rows.withColumn("w", F.lit("")))}
    assert len(others) == 3 and first not in others
    assert evaluation_sets.fingerprint(rows.where("false"), "at", ["v"]) == evaluation_sets._EMPTY
