"""Queries of small tables: images without rows, intervals in columns, masked means, genuine codes, tracks from zero, centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.operators import annotations, reports, scoring, tracks
from tarmac.plans.annotation_queries import _t
from tarmac.plans.track_queries import _PTS, _points

_METRICS = ["m1", "m2", "m3", "m4", "m5"]


def images_without_rows(spark, sf_dir):
    images = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_name").alias("image"))
    return reports.images_without_rows(images, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("segment")), "segment")


def interval_pivot(spark, sf_dir):
    price = F.col("o_totalprice").cast("double")
    long = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("model"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("metric"))
    long = long.agg(F.round(F.avg(price), 6).alias("value"), F.min(price).alias("low"), F.max(price).alias("high"))
    return reports.to_wide_intervals(long, "model", "metric", _METRICS, "value", "low", "high")


def masked_means(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").withColumn("tax", F.when(F.col("l_tax") != 0, F.col("l_tax").cast("double")))
    made = scoring.masked_mean(items, ["l_returnflag", "l_linestatus"], "tax", F.col("l_quantity") > 25)
    return made.withColumn("mean", F.round("mean", 8))


def genuine_codes(spark, sf_dir):
    code = F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 5 - 1).cast("int")
    e = _t(spark, sf_dir, "events").withColumn("code", code)
    return e.groupBy("event_type").agg(F.count_if(codes.is_genuine(F.col("code"))).alias("given"), F.count(F.lit(1)).alias("n"))


def track_from_zero(spark, sf_dir):
    return tracks.from_zero(_points(spark, sf_dir), "track_id", "t").select("track_id", "t", F.round("lon", 6).alias("lon"))


def sibling_centroids(spark, sf_dir):
    p = _t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("recording"), "value")
    return annotations.sibling_centroids(p, "recording", F.col("event_id") % 4 != 0, ["value"]).withColumn("value", F.round("value", 6))


QUERIES = {
    "images_without_rows": (images_without_rows, "SELECT c_custkey AS segment, c_name AS image FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"),
    "interval_pivot": (
        interval_pivot,
        "WITH l AS (SELECT o_custkey % 50 AS model, 'm' || o_orderpriority[1] AS metric, round(avg(o_totalprice::DOUBLE), 6) AS value, min(o_totalprice::DOUBLE) AS low, max(o_totalprice::DOUBLE) AS high FROM orders GROUP BY 1, 2) SELECT model, "
        + ", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}{end}" for m in _METRICS for c, end in (("value", ""), ("low", "_low"), ("high", "_high")))
        + " FROM l GROUP BY model",
    ),
    "masked_means": (
        masked_means,
        "SELECT l_returnflag, l_linestatus, round(avg(l_tax::DOUBLE) FILTER (l_quantity > 25 AND l_tax <> 0), 8) AS mean, count(*) FILTER (l_quantity > 25 AND l_tax <> 0) AS n_defined FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "genuine_codes": (genuine_codes, "SELECT event_type, count(*) FILTER (event_id % 7 <> 0 AND user_id % 5 - 1 <> -1) AS given, count(*) AS n FROM events GROUP BY event_type"),
    "track_from_zero": (track_from_zero, _PTS + " SELECT track_id, t - min(t) OVER (PARTITION BY track_id) AS t, round(lon, 6) AS lon FROM pts"),
    "sibling_centroids": (
        sibling_centroids,
        "WITH m AS (SELECT user_id, median(value) AS v FROM events WHERE event_id % 4 <> 0 GROUP BY user_id) SELECT event_id, e.user_id AS recording, round(m.v, 6) AS value FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE event_id % 4 = 0",
    ),
}
