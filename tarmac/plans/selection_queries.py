"""Queries of selections and report tables: orders stand for segments, customers for roads, priorities for splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import bootstrap, metric_registry, report_tables, scoring, selection
from tarmac.plans.scoring_queries import _P, predictions, rounded

ATTRIBUTES = ["surface", "width"]
STRICT, LENIENT = selection.Preset((-1, 0, 1), False, True), selection.Preset((0, 1), True, False)


def _steps(spark, sf_dir, preset):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    split = F.when(F.col("o_orderpriority") == "5-LOW", "unlabeled_train").otherwise(F.col("o_orderpriority"))
    splits = orders.select(split.alias("split"), key.alias("place"), key.alias("segment_id"))
    images = orders.where(key % 11 != 0).select(key.alias("segment_id"), F.concat(F.lit("img/"), key.cast("string")).alias("path"))
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), (key % m).cast("int").alias("class_idx")) for a, m in (("surface", 3), ("width", 5))]))
    labels = orders.select(key.alias("segment_id"), both.alias("x")).select("segment_id", "x.*").where("not (attribute = 'width' and segment_id % 4 = 0)")
    # The second road of a segment is that of all orders of its clerk's number; the first is the customer's.
    roads = orders.where(key % 13 != 0).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("road_id"), key.alias("place"), key.alias("segment_id"))
    more = orders.where(key % 3 == 0).select(F.concat(F.lit("g"), (key % 97).cast("string")).alias("road_id"), key.alias("place"), key.alias("segment_id"))
    subset = orders.where(key % 5 != 0).select(key.alias("segment_id"))
    return selection.passed_steps(splits, images, labels, roads.unionByName(more), ATTRIBUTES, preset, subset)


def selected_segments(spark, sf_dir):
    """Segments of all splits with labels of all attributes and both neighbours, within the subset."""
    chosen = selection.selected(_steps(spark, sf_dir, STRICT))
    return chosen.select("split", "place", "segment_id", "path", "road_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",", "-").alias("labels"), F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


def selection_steps(spark, sf_dir):
    """How many listed segments of each split pass each step."""
    return selection.step_counts(_steps(spark, sf_dir, STRICT))


def selected_labels(spark, sf_dir):
    """Labelled segments of each attribute and split where missing labels are allowed."""
    return selection.labelled_counts(selection.selected(_steps(spark, sf_dir, LENIENT)), ATTRIBUTES)


def _methods(spark, sf_dir):
    """Two methods of two models each: segments by their remainder of four."""
    rows = predictions(spark, sf_dir)
    model = (F.col("segment_id") % 4).cast("string")
    return rows.withColumn("model", model).withColumn("method", F.when(F.col("model").isin("0", "1"), "north").otherwise("south"))


def method_averages(spark, sf_dir):
    """Means over attributes and models, with bounds."""
    rows = _methods(spark, sf_dir)
    values = metric_registry.metrics(rows, ["method", "model"], ["aA", "amF1"])
    models = rows.select("method", "model", F.lit("exclude").alias("null_policy"), F.lit("test").alias("split_use")).distinct()
    bounds = values.groupBy("method", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(report_tables.method_average_table(values, models, bounds, ["aA", "amF1"]))


def method_comparison(spark, sf_dir):
    """Accuracies of two methods, their differences and intervals over 200 resamples."""
    rows = _methods(spark, sf_dir).where("label is not null")
    own = {m: metric_registry.metrics(rows.where(F.col("method") == m), [], ["A"]) for m in ("north", "south")}
    hits = rows.groupBy("method", "attribute", "sequence_id").agg(F.count_if(F.col("label") == F.col("pred")).alias("h"), F.count(F.lit(1)).alias("n"))
    weights = bootstrap.group_weights(rows, "sequence_id", 200)
    drawn = hits.join(weights, "sequence_id").groupBy("method", "attribute", "resample").agg(F.try_divide(F.sum(F.col("h") * F.col("weight")), F.sum(F.col("n") * F.col("weight"))).alias("value"))
    a, b = (drawn.where(F.col("method") == m) for m in ("north", "south"))
    differences = scoring.percentile_interval(scoring.paired_differences(a, b, ["attribute", "resample"]), ["attribute"], "difference")
    return rounded(report_tables.comparison_table(own["north"], own["south"], differences.withColumn("metric", F.lit("A"))))


_CHAIN = """WITH o AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unlabeled_train' ELSE o_orderpriority END AS split FROM orders),
    r AS (SELECT 'c' || o_custkey AS road_id, k FROM o WHERE k % 13 <> 0 UNION ALL SELECT 'g' || (k % 97), k FROM o WHERE k % 3 = 0),
    s AS (SELECT *, count(*) OVER (PARTITION BY road_id) AS len, row_number() OVER w AS pos,
                 CASE WHEN lag(k) OVER w % 11 <> 0 THEN lag(k) OVER w END AS p, CASE WHEN lead(k) OVER w % 11 <> 0 THEN lead(k) OVER w END AS n
          FROM r WINDOW w AS (PARTITION BY road_id ORDER BY k)),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY len DESC, road_id, pos) = 1),
    t AS (SELECT o.split, o.k, b.road_id, b.p, b.n, starts_with(split, 'unlabeled') AS u, o.k % 11 <> 0 AS s1, u OR o.k % 4 <> 0 AS s2, b.k IS NOT NULL AS s3,
                 b.p IS NOT NULL AND b.n IS NOT NULL AND o.k % 11 <> 0 AS s4, b.n IS NOT NULL AND o.k % 11 <> 0 AS s4n, u OR o.k % 5 <> 0 AS s5 FROM o LEFT JOIN b ON b.k = o.k)"""
_MODELS = _P + """, q AS (SELECT *, segment_id % 4 AS model, CASE WHEN segment_id % 4 < 2 THEN 'north' ELSE 'south' END AS method FROM p WHERE label IS NOT NULL)"""

QUERIES = {
    "selected_segments": (selected_segments, _CHAIN + """ SELECT split, k AS place, k AS segment_id, 'img/' || k AS path, road_id,
        CASE WHEN u THEN '-,-' ELSE (k % 3) || ',' || (k % 5) END AS labels, p || ',' || k || ',' || n AS context FROM t WHERE s1 AND s2 AND s3 AND s4 AND s5"""),
    "selection_steps": (selection_steps, _CHAIN + """ SELECT split, count(*) AS listed, count(*) FILTER (s1) AS image, count(*) FILTER (s1 AND s2) AS labels, count(*) FILTER (s1 AND s2 AND s3) AS road,
        count(*) FILTER (s1 AND s2 AND s3 AND s4) AS context, count(*) FILTER (s1 AND s2 AND s3 AND s4 AND s5) AS subset FROM t GROUP BY split"""),
    "selected_labels": (selected_labels, _CHAIN + """ SELECT split, a AS attribute, count(*) FILTER (NOT u AND (a = 'surface' OR k % 4 <> 0)) AS n
        FROM t, (VALUES ('surface'), ('width')) v(a) WHERE s1 AND s3 AND s4n GROUP BY ALL"""),
    "method_averages": (method_averages, _MODELS + """,
        sides AS (SELECT method, model, attribute, label AS class, 1 AS s, 0 AS c, (label = pred)::INT AS t FROM q UNION ALL SELECT method, model, attribute, pred, 0, 1, 0 FROM q),
        g AS (SELECT method, model, attribute, class, sum(s) AS s, sum(c) AS c, sum(t) AS t FROM sides GROUP BY ALL),
        a AS (SELECT method, model, attribute, sum(t) / sum(c) AS acc, avg(2 * t / (s + c)) AS f FROM g GROUP BY ALL),
        m AS (SELECT method, model, avg(acc) AS acc, avg(f) AS f FROM a GROUP BY ALL)
        SELECT method, count(*) AS models, 'exclude' AS null_policy, 'test' AS split_use, round(avg(acc), 6) AS "aA", round(min(acc), 6) AS "aA low", round(max(acc), 6) AS "aA high",
               round(avg(f), 6) AS "amF1", round(min(f), 6) AS "amF1 low", round(max(f), 6) AS "amF1 high" FROM m GROUP BY method"""),
    "method_comparison": (method_comparison, _MODELS + f""", w AS ({bootstrap.group_weights_sql("q", "sequence_id", 200)}),
        v AS (SELECT method, attribute, avg((label = pred)::INT) AS v FROM q GROUP BY ALL),
        r AS (SELECT method, attribute, resample, sum(CASE WHEN label = pred THEN weight ELSE 0 END) / sum(weight) AS v FROM q JOIN w USING (sequence_id) GROUP BY ALL),
        d AS (SELECT x.attribute, x.v - y.v AS d FROM r x JOIN r y ON x.attribute = y.attribute AND x.resample = y.resample AND x.method = 'north' AND y.method = 'south'),
        i AS (SELECT attribute, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY attribute)
        SELECT 'A (' || attribute || ')' AS metric, round(x.v, 6) AS a, round(y.v, 6) AS b, round(x.v - y.v, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high
        FROM v x JOIN v y USING (attribute) JOIN i USING (attribute) WHERE x.method = 'north' AND y.method = 'south'"""),
}
