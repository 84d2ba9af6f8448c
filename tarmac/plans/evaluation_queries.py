"""Queries of evaluation sets and of metrics by name, on the stand-in predictions of the scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import evaluation_sets, metric_registry
from tarmac.plans.scoring_queries import _CLASSES, _METRICS, _P, _SUMS, ATTRIBUTES, predictions, rounded

#: All segments, a stand-in of complete context windows, and a subset of that.
_SET_SQL = {"full": "true", "reference": "segment_id % 20 BETWEEN 2 AND 17", "north": "segment_id % 20 BETWEEN 2 AND 17 AND segment_id % 3 = 0"}
NAMES = ["mF1", "A", "amF1", "NLL", "aBrier", "mP_supp40", "amP_supp40"]


def _submissions(spark, sf_dir):
    """Three: a with nulls, b without ``curve``, c without some segments that only the full set has."""
    base = predictions(spark, sf_dir)
    a = base.select(F.lit("a").alias("submission"), "segment_id", "attribute", F.when(F.col("segment_id") % 5 == 0, None).otherwise(F.col("pred")).alias("pred"))
    b = base.where("attribute <> 'curve'").select(F.lit("b").alias("submission"), "segment_id", "attribute", ((F.col("pred") + 1) % 10).alias("pred"))
    c = base.where(F.col("segment_id") % 20 != 1).select(F.lit("c").alias("submission"), "segment_id", "attribute", "pred")
    return a.unionByName(b).unionByName(c)


def _scored(spark, sf_dir, **policies):
    labels = evaluation_sets.with_sets(predictions(spark, sf_dir).select("segment_id", "attribute", "label"), {k: F.expr(v) for k, v in _SET_SQL.items()})
    return evaluation_sets.score_sets(_submissions(spark, sf_dir), labels, list(_SET_SQL), list(ATTRIBUTES), **policies)


def set_scores(spark, sf_dir):
    """All submissions on all sets; what a submission lacks of an attribute is invalid, and invalid is the first class."""
    return rounded(_scored(spark, sf_dir, missing_policy="invalid")[0])


def set_scores_strict(spark, sf_dir):
    """The same where a missing attribute is an error and invalid predictions are left out."""
    return rounded(_scored(spark, sf_dir, null_policy="exclude")[0])


def set_states(spark, sf_dir):
    """Labelled, invalid and missing predictions, and errors."""
    return _scored(spark, sf_dir)[1]


def set_fingerprints(spark, sf_dir):
    """Digests of the orders in order of their keys, and of two of them swapped."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    low = orders.agg(F.min("o_orderkey")).first()[0]
    swapped = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == low, -1).otherwise(F.col("o_custkey")))
    made = [(name, evaluation_sets.fingerprint(df, "o_orderkey", ["o_custkey"])) for name, df in (("as it is", orders), ("changed", swapped))]
    return spark.createDataFrame(made, "name string, fingerprint string")


def metrics_by_name(spark, sf_dir):
    return rounded(metric_registry.metrics(predictions(spark, sf_dir), [], NAMES))


def metric_ratios(spark, sf_dir):
    """Values of odd segments in units of those of even ones."""
    a, b = (metric_registry.metrics(predictions(spark, sf_dir).where(F.col("segment_id") % 2 == k), [], ["mF1", "amF1"]) for k in (1, 0))
    return rounded(metric_registry.aligned(a, b, [], F.try_divide))


_SUBMISSIONS = _P + """, subs AS (
    SELECT 'a' AS submission, segment_id, attribute, CASE WHEN segment_id % 5 = 0 THEN NULL ELSE pred END AS pred FROM p
    UNION ALL SELECT 'b', segment_id, attribute, (pred + 1) % 10 FROM p WHERE attribute <> 'curve'
    UNION ALL SELECT 'c', segment_id, attribute, pred FROM p WHERE segment_id % 20 <> 1)"""
# Set by set: every set scans the predictions.
_BY_SET = ", by_set AS (" + " UNION ALL ".join(f"""
    SELECT s.submission, '{name}' AS set, p.attribute, p.segment_id, p.label, q.pred, q.segment_id IS NOT NULL AS there
    FROM p CROSS JOIN (SELECT DISTINCT submission FROM subs) s LEFT JOIN subs q ON q.submission = s.submission AND q.segment_id = p.segment_id AND q.attribute = p.attribute
    WHERE p.label IS NOT NULL AND {condition.replace('segment_id', 'p.segment_id')}""" for name, condition in _SET_SQL.items()) + ")"
_STATES = _SUBMISSIONS + _BY_SET + """, states AS (
    SELECT submission, set, attribute, count(*) AS labelled, CASE WHEN bool_or(there) THEN count(*) FILTER (there AND pred IS NULL) ELSE count(*) END AS invalid,
           CASE WHEN bool_or(there) THEN count(*) FILTER (NOT there) ELSE 0 END AS missing,
           CASE WHEN NOT bool_or(there) THEN 'attribute' WHEN NOT bool_and(there) THEN 'segments' END AS error
    FROM by_set GROUP BY ALL)"""


def _scores(errors: str, pred: str) -> str:
    return _STATES + f""", good AS (SELECT submission, set FROM states GROUP BY ALL HAVING count(*) FILTER ({errors}) = 0),
        c AS (SELECT submission, set, attribute, label, {pred} AS pred FROM by_set JOIN good USING (submission, set) WHERE {pred} IS NOT NULL),
        sides AS (SELECT submission, set, attribute, label AS class, 1 AS s, 0 AS q, (label = pred)::INT AS t FROM c UNION ALL SELECT submission, set, attribute, pred, 0, 1, 0 FROM c),
        classes AS (SELECT submission, set, attribute, class, sum(s) AS s, sum(q) AS q, sum(t) AS t FROM sides GROUP BY ALL),
        m AS (SELECT submission, set, attribute, avg(2 * t / (s + q)) AS "mF1", sum(t) / sum(q) AS "A" FROM classes GROUP BY ALL)
        SELECT submission, set, attribute, metric, round(value, 6) AS value FROM (UNPIVOT m ON "mF1", "A" INTO NAME metric VALUE value)"""


_NAMED = _CLASSES + ", m AS (" + _METRICS.replace(", 6)", ", 15)") + """),
    su AS (SELECT attribute, avg(pr) FILTER (support >= 40) AS mp40 FROM scored GROUP BY attribute),
    pr AS (SELECT attribute, sum(nll) / sum(support) AS nll, sum(brier) / sum(support) AS brier FROM ("""  # noqa: E501
_PROB = _SUMS.split(", sums AS (", 1)[1].rsplit(")", 1)[0]
_BY_NAME = _NAMED + _PROB + """) GROUP BY attribute)
    SELECT attribute, metric, round(value, 6) AS value FROM (
        SELECT attribute, 'mF1' AS metric, mf1 AS value FROM m UNION ALL SELECT attribute, 'A', accuracy FROM m UNION ALL SELECT NULL, 'amF1', avg(mf1) FROM m
        UNION ALL SELECT attribute, 'NLL', nll FROM pr UNION ALL SELECT NULL, 'aBrier', avg(brier) FROM pr
        UNION ALL SELECT attribute, 'mP_supp40', mp40 FROM su UNION ALL SELECT NULL, 'amP_supp40', avg(mp40) FROM su)"""

QUERIES = {
    "set_scores": (set_scores, _scores("error = 'segments'", "coalesce(pred, 0)")),
    "set_scores_strict": (set_scores_strict, _scores("error IS NOT NULL OR invalid = labelled", "pred")),
    "set_states": (set_states, _STATES + " SELECT * FROM states"),
    "set_fingerprints": (set_fingerprints, """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
        v AS (SELECT 'as it is' AS name, i, o_custkey AS c FROM r UNION ALL SELECT 'changed', i, CASE WHEN i = 0 THEN -1 ELSE o_custkey END FROM r),
        d0 AS (SELECT name, i // 1024 AS i, sha256(string_agg(sha256('{"o_custkey":' || c || '}'), '' ORDER BY i)) AS d FROM v GROUP BY name, i // 1024),
        d1 AS (SELECT name, i // 1024 AS i, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN d END AS alone, d, i AS j FROM d0)
        SELECT name, coalesce(any_value(alone), sha256(string_agg(d, '' ORDER BY j))) AS fingerprint FROM d1 GROUP BY name"""),
    "metrics_by_name": (metrics_by_name, _BY_NAME),
    "metric_ratios": (metric_ratios, _P + """, c AS (SELECT segment_id % 2 AS odd, attribute, label, pred FROM p WHERE label IS NOT NULL),
        sides AS (SELECT odd, attribute, label AS class, 1 AS s, 0 AS q, (label = pred)::INT AS t FROM c UNION ALL SELECT odd, attribute, pred, 0, 1, 0 FROM c),
        f AS (SELECT odd, attribute, avg(2 * t / (s + q)) AS v FROM (SELECT odd, attribute, class, sum(s) AS s, sum(q) AS q, sum(t) AS t FROM sides GROUP BY ALL) GROUP BY ALL),
        g AS (SELECT odd, attribute, 'mF1' AS metric, v FROM f UNION ALL SELECT odd, NULL, 'amF1', avg(v) FROM f GROUP BY odd)
        SELECT a.attribute, a.metric, round(a.v / b.v, 6) AS value FROM g a JOIN g b ON a.odd = 1 AND b.odd = 0 AND a.metric = b.metric AND a.attribute IS NOT DISTINCT FROM b.attribute"""),
}
