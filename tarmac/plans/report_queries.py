"""Queries of reports, selections, names and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import ensembles, reports, roads, scoring
from tarmac.plans import scoring_queries as sq
from tarmac.plans.road_queries import _E, _events
from tarmac.plans.scoring_queries import _CLASSES, _METRICS, _P, rounded


def long_report(spark, sf_dir):
    return rounded(reports.to_long(sq._attributes(spark, sf_dir), ["attribute"], ["accuracy", "mf1", "mcc"]))


def pivot_report(spark, sf_dir):
    long = reports.to_long(sq._attributes(spark, sf_dir), ["attribute"], ["accuracy", "mf1", "mcc"])
    return rounded(reports.to_wide(long, "attribute", "metric", ["accuracy", "mf1", "mcc"], "value"))


def coding_table(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).select("segment_id", "attribute", F.col("pred").cast("string").alias("code"))
    return reports.to_wide(p, "segment_id", "attribute", list(sq.ATTRIBUTES), "code", with_average=False)


def confidence_table(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).select("segment_id", "attribute", F.array_max("probs").alias("c"))
    return rounded(reports.to_wide(p, "segment_id", "attribute", list(sq.ATTRIBUTES), "c", with_average=False))


def confident_errors(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).withColumn("confidence", F.round(F.array_max("probs"), 9))
    return reports.confident_errors(p, 3, 4, F.col("confidence"), "segment_id").select("attribute", "segment_id", "place")


def multi_attribute_filter(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).withColumn("code", F.col("pred").cast("string"))
    return reports.matching(p, "segment_id", "attribute", "code", {"surface": ["0", "1", "2", "3", "4"], "width": ["5", "6", "7", "8", "9"]})


def log_priors(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).where("label is not null").groupBy("attribute", "label").agg(F.count(F.lit(1)).alias("n"))
    return rounded(reports.log_priors(p, ["attribute"], "n", 10))


_NAMES = ["amF1_supp10", "A", "mIoU", "aNLL", "cBrier", "F1_supp", "", "xA", "akappa", "K_supp30"]


def metric_names(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    names = r.select("r_regionkey", F.explode(F.array(*map(F.lit, _NAMES))).alias("name")).withColumn("m", reports.metric_name(F.col("name")))
    return names.select("r_regionkey", "name", "m.base", "m.averaged", "m.min_support")


def file_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", reports.safe_name(F.concat_ws(" / ", "p_name", "p_brand", "p_type"), 30).alias("name"))


def invalid_predictions(spark, sf_dir):
    p = sq.predictions(spark, sf_dir)
    k = F.col("segment_id") % 6
    bad = F.when(k == 1, F.slice("probs", 1, 9)).when(k == 2, F.transform("probs", lambda x: x * 1.01)).when(k == 3, F.transform("probs", lambda x: -x)).when(k == 4, None).otherwise(F.col("probs"))
    return p.select("attribute", reports.invalid_reason(bad, 10).alias("reason")).groupBy("attribute", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def model_errors(spark, sf_dir):
    key = F.col("o_orderkey")
    seed = F.when(key % 97 != 0, F.when(F.col("o_custkey") % 5 == 0, F.lit(1)).otherwise(key % 4))
    models = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(key / 4).alias("method"), seed.alias("seed"), "o_orderstatus")
    return reports.model_errors(models, "method", "seed", "o_orderstatus")


def neighbours(spark, sf_dir):
    return reports.near_on_road(_events(spark, sf_dir), "road_id", "position", ["segment_id", "event_type"], F.col("event_type") == "purchase", 3)


def fixed_permutation(spark, sf_dir):
    return reports.shuffled(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey"), "n_nationkey", 7)


def ratio_split(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return reports.ratio_split(c, F.col("c_custkey"), 0.25).groupBy("first").agg(F.count(F.lit(1)).alias("n"))


def image_match(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("segment"))
    images = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("segment"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("path")).distinct()
    return reports.rows_with_images(o, images, "segment")


def key_union(spark, sf_dir):
    rows = sq.predictions(spark, sf_dir).where(F.col("label").isNotNull() & (F.col("pred") > 6))
    return ensembles.all_keys(rows, ["segment_id"])


def invalid_segments_added(spark, sf_dir):
    p = sq.predictions(spark, sf_dir).where("attribute = 'surface'")
    return ensembles.add_missing(p.where("pred > 4").select("segment_id", "pred"), p.select("segment_id"), ["segment_id"])


def coverage_choice(spark, sf_dir):
    """Labels and predictions of a set: how many of its segments each attribute predicts, and whether it covers the set."""
    p = sq.predictions(spark, sf_dir)
    want = p.where("segment_id % 2 = 0").select("segment_id").distinct()
    have = p.where("pred < 8").select("attribute", "segment_id").distinct()
    total = want.agg(F.count(F.lit(1)).alias("total"))
    return have.join(want, "segment_id").groupBy("attribute").agg(F.count(F.lit(1)).alias("covered")).join(F.broadcast(total)).select("attribute", "covered", (F.col("covered") == F.col("total")).alias("complete"))


def end_coordinates(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("start_m", F.col("position") * 20 + F.when(F.col("value") > 60, 5).otherwise(0))
    nxt = roads.context(e, "road_id", "position", "start_m", (1,))
    return nxt.select("segment_id", F.when(F.abs(F.col("context")[0] - F.col("start_m") - 20) <= 1, F.col("context")[0]).alias("end_m"))


def class_table(spark, sf_dir):
    c = scoring.class_metrics(scoring.confusion_cells(sq.predictions(spark, sf_dir), ["attribute"]), ["attribute"])
    return rounded(c.groupBy("class").pivot("attribute", list(sq.ATTRIBUTES)).agg(F.first("f1")))


QUERIES = {
    "long_report": (long_report, _CLASSES + f", m AS ({_METRICS}) SELECT attribute, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT attribute, 'mf1', mf1 FROM m UNION ALL SELECT attribute, 'mcc', mcc FROM m"),
    "pivot_report": (pivot_report, _CLASSES + f", m AS ({_METRICS.replace(', 6)', ', 12)')}) SELECT attribute, round(accuracy, 6) AS accuracy, round(mf1, 6) AS mf1, round(mcc, 6) AS mcc FROM m UNION ALL SELECT 'average', round(avg(accuracy), 6), round(avg(mf1), 6), round(avg(mcc), 6) FROM m"),
    "coding_table": (coding_table, _P + " SELECT segment_id, " + ", ".join(f"max(pred) FILTER (attribute = '{a}')::VARCHAR AS {a}" for a in sq.ATTRIBUTES) + " FROM p GROUP BY segment_id"),
    "confidence_table": (confidence_table, _P + " SELECT segment_id, " + ", ".join(f"round(max(list_max(probs)) FILTER (attribute = '{a}'), 6) AS {a}" for a in sq.ATTRIBUTES) + " FROM p GROUP BY segment_id"),
    "confident_errors": (confident_errors, _P + " SELECT attribute, segment_id, row_number() OVER (PARTITION BY attribute ORDER BY round(list_max(probs), 9) DESC, segment_id)::INT AS place FROM p WHERE label = 3 AND pred = 4"),
    "multi_attribute_filter": (multi_attribute_filter, _P + " SELECT segment_id FROM p WHERE attribute = 'surface' AND pred < 5 INTERSECT SELECT segment_id FROM p WHERE attribute = 'width' AND pred >= 5"),
    "log_priors": (log_priors, _P + " SELECT attribute, label::INT AS label, count(*) AS n, round(ln((count(*) + 1) / (sum(count(*)) OVER (PARTITION BY attribute) + 10)), 6) AS log_prior FROM p WHERE label IS NOT NULL GROUP BY attribute, label"),
    "metric_names": (metric_names, "SELECT r_regionkey, name, base, averaged, min_support FROM region, (VALUES ('amF1_supp10', 'mF1', true, 10), ('A', 'A', false, NULL), ('mIoU', 'mIoU', false, NULL), ('aNLL', 'NLL', true, NULL), ('cBrier', 'cBrier', false, NULL), ('F1_supp', NULL, NULL, NULL), ('', NULL, NULL, NULL), ('xA', NULL, NULL, NULL), ('akappa', 'kappa', true, NULL), ('K_supp30', 'K', false, 30)) v(name, base, averaged, min_support)"),
    "file_names": (file_names, r"WITH n AS (SELECT p_partkey, p_name || ' / ' || p_brand || ' / ' || p_type AS name FROM part), c AS (SELECT *, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS clean FROM n) SELECT p_partkey, CASE WHEN length(clean) > 30 THEN left(clean, 21) || '-' || left(sha256(name), 8) ELSE clean END AS name FROM c"),
    "invalid_predictions": (invalid_predictions, _P + " SELECT attribute, CASE segment_id % 6 WHEN 1 THEN 'size' WHEN 2 THEN 'sum' WHEN 3 THEN 'value' ELSE 'none' END AS reason, count(*) AS n FROM p GROUP BY ALL"),
    "model_errors": (model_errors, """WITH g AS (SELECT o_orderkey // 4 AS method, count(*) AS n, count(seed) AS w, count(DISTINCT seed) AS d, count(DISTINCT o_orderstatus) AS s
        FROM (SELECT *, CASE WHEN o_orderkey % 97 <> 0 THEN CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 END END AS seed FROM orders) GROUP BY 1),
        r AS (SELECT method, CASE WHEN n > 1 AND w < n THEN 'missing seed' WHEN n > 1 AND d < n THEN 'repeated seed' WHEN s > 1 THEN 'different splits' END AS error FROM g) SELECT * FROM r WHERE error IS NOT NULL"""),
    "neighbours": (neighbours, _E + " SELECT c.segment_id AS center, (o.position - c.position)::INT AS offset, o.segment_id, o.event_type FROM e c JOIN e o ON c.road_id = o.road_id AND o.position BETWEEN c.position - 3 AND c.position + 3 AND o.position <> c.position WHERE c.event_type = 'purchase'"),
    "fixed_permutation": (fixed_permutation, "SELECT n_nationkey FROM nation"),
    "ratio_split": (ratio_split, None),
    "image_match": (image_match, """WITH i AS (SELECT l_orderkey AS segment, count(DISTINCT l_partkey) AS n, min(l_orderkey || '/' || l_partkey) AS path FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
        SELECT o_orderkey AS segment, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS state FROM orders LEFT JOIN i ON segment = o_orderkey"""),
    "key_union": (key_union, _P + " SELECT DISTINCT segment_id FROM p WHERE label IS NOT NULL AND pred > 6"),
    "invalid_segments_added": (invalid_segments_added, _P + " SELECT segment_id, CASE WHEN pred > 4 THEN pred END::INT AS pred FROM p WHERE attribute = 'surface'"),
    "coverage_choice": (coverage_choice, _P + ", w AS (SELECT DISTINCT segment_id FROM p WHERE segment_id % 2 = 0) SELECT attribute, count(*) AS covered, count(*) = (SELECT count(*) FROM w) AS complete FROM p JOIN w USING (segment_id) WHERE pred < 8 GROUP BY attribute"),
    "end_coordinates": (end_coordinates, _E + ", s AS (SELECT *, position * 20 + CASE WHEN value > 60 THEN 5 ELSE 0 END AS m FROM e), n AS (SELECT *, lead(m) OVER (PARTITION BY road_id ORDER BY position) AS x FROM s) SELECT segment_id, CASE WHEN abs(x - m - 20) <= 1 THEN x END::INT AS end_m FROM n"),
    "class_table": (class_table, _CLASSES + " SELECT class::INT AS class, " + ", ".join(f"round(max(f) FILTER (attribute = '{a}'), 6) AS {a}" for a in sq.ATTRIBUTES) + " FROM scored GROUP BY class"),
}
