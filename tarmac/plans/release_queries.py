"""Queries of methods and releases: orders stand for segments, customers for roads, priorities for splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import metric_registry, releases, selection
from tarmac.plans.scoring_queries import _P, predictions, rounded
from tarmac.plans.selection_queries import _CHAIN, ATTRIBUTES, LENIENT, _steps


def method_scores(spark, sf_dir):
    """Means of methods whose models can be combined, and why others can't: segments by their remainder of six are models."""
    rows = predictions(spark, sf_dir).where("label is not null").withColumn("model", (F.col("segment_id") % 6).cast("string"))
    values = metric_registry.metrics(rows.where("not (model = '3' and attribute = 'curve')"), ["model"], ["A", "mF1"])
    models = spark.createDataFrame([("a", "0", 1, "s"), ("a", "1", 2, "s"), ("b", "2", 1, "s"), ("b", "3", 2, "s"), ("c", "4", 1, "s"), ("c", "5", None, "s"), ("d", "0", 1, "s"), ("d", "4", 2, "t"), ("e", "3", None, "s")], "method string, model string, seed int, set_fingerprint string")
    return rounded(releases.method_scores(models, values, ["surface", "curve"]))


def common_sets(spark, sf_dir):
    """The set on which all customers of a nation are scored; sets are the priorities of their orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("set"))
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 40 = 1").select("c_custkey", F.col("c_nationkey").alias("split"))
    scorings = orders.join(nations, "c_custkey").select("split", F.col("c_custkey").alias("model"), "set", F.col("set").alias("set_fingerprint"))
    return releases.common_sets(scorings, ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH"])


def split_statistics(spark, sf_dir):
    """Splits in two selections, and all splits together."""
    steps = _steps(spark, sf_dir, LENIENT)
    names = {"labelled": F.col("passed") >= 3, "with_context": F.col("passed") >= len(selection.STEPS)}
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("selection"), ok.alias("ok")) for n, ok in names.items()]), lambda s: s["ok"]))
    chosen = steps.withColumn("s", each).select("split", "s.selection", "segment_id", "labels")
    roads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("road_id"))
    return releases.split_statistics(chosen, roads, ATTRIBUTES)


def ordered_distributions(spark, sf_dir):
    """Statuses of orders by priority, priorities by imbalance, statuses by number."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    counts = orders.groupBy(F.col("o_orderpriority").alias("attribute"), F.substring("o_orderpriority", 1, 1).cast("int").alias("place"), F.ascii("o_orderstatus").alias("class_idx")).agg(F.count(F.lit(1)).alias("n"))
    return releases.ordered_distributions(counts, "imbalance", "count")


def unlabelled_sequences(spark, sf_dir):
    """Runs of lines of an order that no road has; roads have the lines of every fourth part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id")
    recordings = items.select(F.col("l_orderkey").cast("string").alias("recording"), number)
    return releases.unlabelled_sequences(recordings, items.where("l_partkey % 4 = 0").select(number))


def splits_of_sequences(spark, sf_dir):
    """Lists of orders by split; customers are assigned to splits by their segments."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("road_id"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("segment_id"))
    assignment = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("road_id"), F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("split"))
    return releases.splits_of_sequences(orders, assignment)


def concatenated_datasets(spark, sf_dir):
    """Suppliers, then customers of one segment, then suppliers again."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name"))
    return releases.concatenated([s, c, s])


def masked_predictions(spark, sf_dir):
    """Classes of the stand-in distributions under a mask."""
    probs, pred = releases.probabilities_with_mask(F.col("probs"), F.when(F.col("segment_id") % 3 > 0, F.col("segment_id") % 4 > 0), 10)
    return predictions(spark, sf_dir).select("segment_id", "attribute", pred.alias("pred"), F.round(F.array_max(probs), 6).alias("confidence"))


QUERIES = {
    "method_scores": (method_scores, _P + """,
        q AS (SELECT segment_id % 6 AS model, attribute, label, pred FROM p WHERE label IS NOT NULL AND NOT (segment_id % 6 = 3 AND attribute = 'curve') AND attribute IN ('surface', 'curve')),
        sides AS (SELECT model, attribute, label AS class, 1 AS s, 0 AS c, (label = pred)::INT AS t FROM q UNION ALL SELECT model, attribute, pred, 0, 1, 0 FROM q),
        g AS (SELECT model, attribute, class, sum(s) AS s, sum(c) AS c, sum(t) AS t FROM sides GROUP BY ALL),
        a AS (SELECT model, attribute, sum(t) / sum(c) AS "A", avg(2 * t / (s + c)) AS "mF1" FROM g GROUP BY ALL),
        m AS (SELECT model, avg("A") AS "A", avg("mF1") AS "mF1" FROM a GROUP BY model),
        ab AS (SELECT avg("A") AS "A", avg("mF1") AS "mF1" FROM m WHERE model IN (0, 1))
        SELECT 'a' AS method, 2 AS models, metric, round(value, 6) AS value, NULL::VARCHAR AS error FROM (UNPIVOT ab ON "A", "mF1" INTO NAME metric VALUE value)
        UNION ALL SELECT * FROM (VALUES ('b', 2, NULL, NULL, 'metrics'), ('c', 2, NULL, NULL, 'seeds'), ('d', 2, NULL, NULL, 'segments'), ('e', 1, NULL, NULL, 'attributes'))"""),
    "common_sets": (common_sets, """WITH s AS (SELECT c_nationkey AS split, c_custkey AS model, o_orderpriority AS set FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 40 = 1),
        p AS (SELECT split, set, count(DISTINCT model) AS n FROM s GROUP BY ALL), w AS (SELECT split, count(DISTINCT model) AS n FROM s GROUP BY split)
        SELECT split, arg_min(set, list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH'], set)) AS set FROM p JOIN w USING (split, n) WHERE set <> '4-NOT SPECIFIED' GROUP BY split"""),
    "split_statistics": (split_statistics, _CHAIN + """, x AS (SELECT split, 'labelled' AS selection, k, o_custkey FROM t JOIN o USING (split, k) WHERE s1 AND NOT u
              UNION ALL SELECT split, 'with_context', k, o_custkey FROM t JOIN o USING (split, k) WHERE s1 AND s3 AND s4n AND NOT u)
        SELECT split, selection, count(*) AS segments, count(DISTINCT o_custkey) AS sequences, 0::BIGINT AS without_labels, count(*) AS surface, count(*) FILTER (k % 4 <> 0) AS width
        FROM x GROUP BY GROUPING SETS ((split, selection), (selection))"""),
    "ordered_distributions": (ordered_distributions, """WITH c AS (SELECT o_orderpriority AS attribute, left(o_orderpriority, 1)::INT AS place, ascii(o_orderstatus) AS class_idx, count(*) AS n FROM orders GROUP BY ALL),
        r AS (SELECT attribute, row_number() OVER (ORDER BY max(n) / min(n) DESC, place) - 1 AS attribute_rank FROM c GROUP BY attribute, place)
        SELECT attribute, place, class_idx, n, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, class_idx) - 1 AS class_rank, attribute_rank FROM c JOIN r USING (attribute)"""),
    "unlabelled_sequences": (unlabelled_sequences, """WITH i AS (SELECT DISTINCT l_orderkey AS rec, l_orderkey * 10 + l_linenumber AS k FROM lineitem
              WHERE l_orderkey * 10 + l_linenumber NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey % 4 = 0)),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY rec ORDER BY k) AS run FROM i)
        SELECT 'unlabeled:' || rec || ':' || min(k) OVER (PARTITION BY rec, run) AS road_id, row_number() OVER (PARTITION BY rec, run ORDER BY k) - 1 AS place, k AS segment_id FROM g"""),
    "splits_of_sequences": (splits_of_sequences, """SELECT c_mktsegment AS split, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_custkey, o_orderkey) - 1 AS place, o_orderkey AS segment_id
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY'"""),
    "concatenated_datasets": (concatenated_datasets, """WITH s AS (SELECT s_suppkey AS place, s_name AS name FROM supplier), c AS (SELECT c_custkey AS place, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'),
        e AS (SELECT (SELECT max(place) + 1 FROM s) AS a, (SELECT max(place) + 1 FROM c) AS b)
        SELECT 0 AS dataset, place, name FROM s UNION ALL SELECT 1, place + a, name FROM c, e UNION ALL SELECT 2, place + a + b, name FROM s, e"""),
    "masked_predictions": (masked_predictions, _P + " SELECT segment_id, attribute, CASE WHEN segment_id % 3 > 0 AND segment_id % 4 > 0 THEN pred END::INT AS pred, CASE WHEN segment_id % 3 > 0 AND segment_id % 4 > 0 THEN round(list_max(probs), 6) END AS confidence FROM p"),
}
