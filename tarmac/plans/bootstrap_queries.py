"""Queries of resampling. Sequences are the customers of ``orders`` or, for predictions, the stand-ins of the scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import draws
from tarmac.operators import bootstrap, scoring
from tarmac.plans.scoring_queries import _P, predictions, rounded

RESAMPLES, CLASSES = 1000, 5


def bootstrap_weights(spark, sf_dir):
    """How often 20 resamples draw each customer with orders."""
    return bootstrap.group_weights(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", 20, seed=3)


def bootstrap_intervals(spark, sf_dir):
    """Intervals of the accuracy of each attribute over 1,000 resamples of sequences."""
    rows = predictions(spark, sf_dir)
    hits = rows.where("label is not null").groupBy("attribute", "sequence_id").agg(F.count_if(F.col("label") == F.col("pred")).alias("hits"), F.count(F.lit(1)).alias("n"))
    weights = bootstrap.group_weights(rows, "sequence_id", RESAMPLES)
    drawn = hits.join(weights, "sequence_id").groupBy("attribute", "resample").agg((F.sum(F.col("hits") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("value"))
    return rounded(scoring.percentile_interval(drawn, ["attribute"]))


def _made(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderkey") % CLASSES)
    return bootstrap.synthetic_logits(orders.select("o_orderkey", "o_custkey", label.alias("label")), "o_orderkey", "o_custkey", "label", CLASSES, seed=5)


def synthetic_logits(spark, sf_dir):
    """Made-up logits of orders, whose customers are the sequences."""
    return rounded(_made(spark, sf_dir).select("o_orderkey", F.posexplode("logits").alias("class", "logit")), 6)


def synthetic_accuracy(spark, sf_dir):
    """Per class of made-up predictions: labels, predictions and hits."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % CLASSES).cast("int").alias("label"))
    made = bootstrap.synthetic_predictions(orders, "o_orderkey", "o_custkey", "label", CLASSES, seed=5)
    return scoring.class_metrics(scoring.confusion_cells(made, []), []).select("class", "support", "predicted", "tp")


def _logit_sql(label: str) -> str:
    own = draws.normal_sql("5", "1", "o_orderkey", "k")
    road = draws.normal_sql("5", "2", "o_custkey", "k")
    return f"""SELECT o_orderkey, k AS class, {own} * sqrt(0.5) + {road} * sqrt(0.5) + CASE WHEN {label} = k THEN 2.0 ELSE 0.0 END AS logit
        FROM orders, range({CLASSES}) t(k)"""


QUERIES = {
    "bootstrap_weights": (bootstrap_weights, bootstrap.group_weights_sql("orders", "o_custkey", 20, 3)),
    "bootstrap_intervals": (bootstrap_intervals, _P + f""", w AS ({bootstrap.group_weights_sql("p", "sequence_id", RESAMPLES)}),
        r AS (SELECT attribute, resample, sum(CASE WHEN label = pred THEN weight ELSE 0 END) / sum(weight) AS v FROM p JOIN w USING (sequence_id) WHERE label IS NOT NULL GROUP BY ALL)
        SELECT attribute, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) FILTER (v IS NULL) AS undefined FROM r GROUP BY attribute"""),
    "synthetic_logits": (synthetic_logits, f"SELECT o_orderkey, class::INT AS class, round(logit, 6) AS logit FROM ({_logit_sql('CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 5 END')})"),
    "synthetic_accuracy": (synthetic_accuracy, f"""WITH l AS ({_logit_sql('o_orderkey % 5')}),
        b AS (SELECT o_orderkey, o_orderkey % 5 AS label, arg_max(class, logit) AS pred FROM l GROUP BY o_orderkey)
        SELECT class::INT AS class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(t)::BIGINT AS tp
        FROM (SELECT label AS class, 1 AS s, 0 AS p, (label = pred)::INT AS t FROM b UNION ALL SELECT pred, 0, 1, 0 FROM b) GROUP BY class"""),
}
