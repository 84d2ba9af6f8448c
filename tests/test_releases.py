"""Methods and releases in small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarmac.operators import releases

MODELS = "method string, model string, seed int, set_fingerprint string"
VALUES = "model string, attribute string, metric string, value double"


def test_undefined_values(spark):
    models = spark.createDataFrame([("m", "1", 1, None), ("m", "2", 2, None), ("n", "3", None, "s"), ("o", "4", None, "s")], MODELS)
    values = spark.createDataFrame([("1", "x", "A", None), ("1", "y", "A", 0.5), ("2", "x", "A", 0.1), ("2", "y", "A", 0.3), ("3", "x", "A", None)], VALUES)
    found = {(r.method, r.metric): (r.value, r.error) for r in releases.method_scores(models, values, ["x"]).collect()}
    assert found == {("m", "A"): (None, None), ("n", "A"): (None, None), ("o", None): (None, "attributes")}
    both = {(r.method, r.metric): r.value for r in releases.method_scores(models.where("method = 'm'"), values, ["x", "y"]).collect()}
    assert both == {("m", "A"): pytest.approx(0.35)}
    with pytest.raises(ValueError):
        releases.method_scores(models, values, [])


def test_no_common_set(spark):
    rows = spark.createDataFrame([("v", "1", "full", "a"), ("v", "2", "full", "b"), ("v", "1", "ref", "c"), ("w", "1", "full", "a"), ("x", "1", "full", None)], "split string, model string, set string, set_fingerprint string")
    assert [tuple(r) for r in releases.common_sets(rows, ["ref", "full"]).collect()] == [("w", "full")]


def test_masks(spark):
    rows = [([0.2, 0.8], True), ([0.2, 0.8], False), ([0.2, 0.8], None), (None, True), ([float("nan"), 1.0], True), ([0.5, 0.5], True), ([1.0], False)]
    df = spark.createDataFrame(rows, "p array<double>, ok boolean")
    probs, pred = releases.probabilities_with_mask(F.col("p"), F.col("ok"), 2)
    assert [tuple(r) for r in df.select(probs, pred).collect()] == [([0.2, 0.8], 1), (None, None), (None, None), (None, None), (None, None), ([0.5, 0.5], 0), (None, None)]
    with pytest.raises(Exception, match="not 3 classes"):
        df.select(*releases.probabilities_with_mask(F.col("p"), F.col("ok"), 3)).collect()


def test_orders_and_empty_tables(spark):
    counts = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 1, 0), ("b", 1, 0, 9), ("b", 1, 1, 3), ("c", 2, 0, 0)], "attribute string, place int, class_idx int, n long")

    def ranks(*orders):
        return {r.attribute: r.attribute_rank for r in releases.ordered_distributions(counts, *orders).collect()}

    assert ranks() == {"a": 0, "b": 1, "c": 2} and ranks("count") == {"b": 0, "a": 1, "c": 2} and ranks("imbalance") == {"b": 0, "a": 1, "c": 2}
    with pytest.raises(ValueError):
        ranks("size")
    none = spark.createDataFrame([], "recording string, segment_id long")
    assert releases.unlabelled_sequences(none, none).count() == 0
    one = spark.createDataFrame([("r", i) for i in (1, 2, 4, 5, 6)], "recording string, segment_id long")
    made = {r.segment_id: (r.road_id, r.place) for r in releases.unlabelled_sequences(one, one.where("segment_id = 5")).collect()}
    assert made == {1: ("unlabeled:r:1", 0), 2: ("unlabeled:r:1", 1), 4: ("unlabeled:r:4", 0), 6: ("unlabeled:r:6", 0)}
    with pytest.raises(ValueError):
        releases.concatenated([])
