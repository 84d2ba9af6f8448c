"""Queries of the scoring operators. Predictions are softmaxes of ten components of ``embeddings``; labels are theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import arrays
from tarmac.operators import bootstrap, ensembles, scoring

#: Stand-ins of attributes: first component of the logits of each.
ATTRIBUTES = {"surface": 0, "width": 10, "curve": 20}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, sequence_id, attribute, label, probs, pred); labels are missing for every seventh segment of ``curve``."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.slice("embedding", s + 1, 10).alias("logits")) for a, s in ATTRIBUTES.items()]))
    rows = base.select(F.col("vec_id").alias("segment_id"), (F.col("vec_id") % 20).alias("sequence_id"), (F.col("label") % 10).alias("label"), each.alias("a"))
    label = F.when((F.col("a.attribute") == "curve") & (F.col("segment_id") % 7 == 0), None).otherwise(F.col("label"))
    rows = rows.select("segment_id", "sequence_id", "a.attribute", label.cast("int").alias("label"), arrays.softmax(F.col("a.logits")).alias("probs"))
    return rows.withColumn("pred", arrays.argmax(F.col("probs")))


_P = """
    WITH logit AS (SELECT vec_id AS segment_id, vec_id % 20 AS sequence_id, a.attribute,
                          CASE WHEN a.attribute = 'curve' AND vec_id % 7 = 0 THEN NULL ELSE label % 10 END AS label,
                          list_transform(embedding[a.s + 1 : a.s + 10], lambda x: x::DOUBLE) AS z
                   FROM embeddings, (VALUES ('surface', 0), ('width', 10), ('curve', 20)) AS a(attribute, s)),
    e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ez FROM logit),
    p AS (SELECT segment_id, sequence_id, attribute, label, list_transform(ez, lambda x: x / list_sum(ez)) AS probs, list_position(z, list_max(z)) - 1 AS pred FROM e)"""
_CELLS = _P + ", cells AS (SELECT attribute, label, pred, count(*) AS n FROM p WHERE label IS NOT NULL GROUP BY ALL)"
_CLASSES = _CELLS + """,
    classes AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM (
        SELECT attribute, class, sum(s) AS support, sum(q) AS predicted, sum(t) AS tp FROM (
            SELECT attribute, label AS class, n AS s, 0 AS q, CASE WHEN label = pred THEN n ELSE 0 END AS t FROM cells
            UNION ALL SELECT attribute, pred, 0, n, 0 FROM cells) GROUP BY ALL)),
    scored AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f, coalesce(tp / nullif(support + predicted - tp, 0), 0) AS iou FROM classes)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last digits don't differ."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def softmax_argmax(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.select("segment_id", "attribute", "pred", F.round(F.array_max("probs"), 6).alias("confidence"))


def confusion_cells(spark, sf_dir):
    return scoring.confusion_cells(predictions(spark, sf_dir), ["attribute"])


def class_metrics(spark, sf_dir):
    return rounded(scoring.class_metrics(scoring.confusion_cells(predictions(spark, sf_dir), ["attribute"]), ["attribute"]))


def _attributes(spark, sf_dir):
    cells = scoring.confusion_cells(predictions(spark, sf_dir), ["attribute"])
    return scoring.attribute_metrics(scoring.class_metrics(cells, ["attribute"]), ["attribute"], min_support=40)


def attribute_metrics(spark, sf_dir):
    return rounded(_attributes(spark, sf_dir).drop("classes_supported", "mf1_supported"))


def support_metrics(spark, sf_dir):
    return rounded(_attributes(spark, sf_dir).select("attribute", "classes_supported", "mf1_supported"))


def attribute_averages(spark, sf_dir):
    return rounded(scoring.average_over(_attributes(spark, sf_dir), [], ["accuracy", "mf1", "mcc"]))


def prob_metrics(spark, sf_dir):
    return rounded(scoring.probability_metrics(scoring.probability_sums(predictions(spark, sf_dir), ["attribute"]), ["attribute"]))


def class_nll(spark, sf_dir):
    sums = scoring.probability_sums(predictions(spark, sf_dir), ["attribute"])
    return rounded(sums.select("attribute", "label", "support", (F.col("nll") / F.col("support")).alias("cnll"), (F.col("brier") / F.col("support")).alias("cbrier")))


def _with_invalid(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("pred", F.when(F.col("segment_id") % 5 == 0, None).otherwise(F.col("pred")))


def _policy(name):
    def run(spark, sf_dir):
        rows = scoring.apply_null_policy(_with_invalid(spark, sf_dir), name)
        classes = scoring.class_metrics(scoring.confusion_cells(rows, ["attribute"]), ["attribute"])
        return rounded(scoring.attribute_metrics(classes, ["attribute"]).select("attribute", "n", "accuracy"))

    return run


def outcome_matrix(spark, sf_dir):
    return scoring.confusion_cells(_with_invalid(spark, sf_dir), ["attribute"]).select("attribute", "label", F.coalesce("pred", F.lit(-1)).alias("outcome"), "n")


def _resampled(spark, sf_dir):
    cells = scoring.confusion_cells(predictions(spark, sf_dir), ["attribute", "sequence_id"])
    drawn = scoring.weighted_cells(cells, bootstrap.group_weights(cells, "sequence_id", 50), ["attribute"])
    return scoring.attribute_metrics(scoring.class_metrics(drawn, ["resample", "attribute"]), ["resample", "attribute"]).select("resample", "attribute", "accuracy")


def bootstrap_weights_det(spark, sf_dir):
    return rounded(_resampled(spark, sf_dir))


def percentile_interval(spark, sf_dir):
    return rounded(scoring.percentile_interval(_resampled(spark, sf_dir), ["attribute"], "accuracy"))


def paired_difference(spark, sf_dir):
    values = _resampled(spark, sf_dir).withColumnRenamed("accuracy", "value")
    a, b = (values.where(F.col("attribute") == x).select("resample", "value") for x in ("surface", "width"))
    diffs = scoring.paired_differences(a, b, ["resample"])
    out = scoring.percentile_interval(diffs.withColumn("pair", F.lit("surface-width")), ["pair"], "difference")
    return rounded(out.withColumn("better", F.coalesce(scoring.better_method(F.col("low"), F.col("high")), F.lit("none"))))


def method_mean(spark, sf_dir):
    seeded = predictions(spark, sf_dir).withColumn("model", F.col("segment_id") % 3)
    cells = scoring.confusion_cells(seeded, ["attribute", "model"])
    values = scoring.attribute_metrics(scoring.class_metrics(cells, ["attribute", "model"]), ["attribute", "model"]).withColumnRenamed("accuracy", "value")
    return rounded(scoring.method_means(values, ["attribute"]))


def ensemble_mean(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("probs", F.when(F.col("segment_id") % 11 == 0, None).otherwise(F.col("probs")))
    weights = {"surface": 1.0, "width": 3.0, "curve": 0.5}
    members = rows.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("attribute")))
    mean = ensembles.weighted_mean(members, ["segment_id"])
    return mean.select("segment_id", F.posexplode_outer("probs").alias("class", "p")).select("segment_id", "class", F.round("p", 6).alias("p"))


def vote_share(spark, sf_dir):
    return rounded(ensembles.vote_shares(predictions(spark, sf_dir), ["segment_id"]))


def key_intersection(spark, sf_dir):
    rows = predictions(spark, sf_dir).where(F.col("label").isNotNull())
    return ensembles.common_keys(rows, ["segment_id"], "attribute", len(ATTRIBUTES))


_METRICS = """SELECT attribute, sum(predicted)::BIGINT AS n, round(sum(tp) / sum(predicted), 6) AS accuracy,
    round((sum(tp)::DOUBLE * sum(predicted) - sum(support::DOUBLE * predicted)) / nullif(pow(sum(predicted), 2) - sum(support::DOUBLE * predicted), 0), 6) AS kappa,
    round((sum(tp)::DOUBLE * sum(predicted) - sum(support::DOUBLE * predicted)) / nullif(sqrt((pow(sum(predicted), 2) - sum(pow(predicted, 2))) * (pow(sum(support), 2) - sum(pow(support, 2)))), 0), 6) AS mcc,
    round(avg(pr), 6) AS mp, round(avg(re), 6) AS mr, round(avg(f), 6) AS mf1, round(avg(iou), 6) AS miou FROM scored GROUP BY attribute"""
_SUMS = _P + """, sums AS (SELECT attribute, label, count(*) AS support, sum(-ln(probs[label + 1])) AS nll,
    sum(1 - 2 * probs[label + 1] + list_sum(list_transform(probs, lambda x: x * x))) AS brier FROM p WHERE label IS NOT NULL GROUP BY ALL)"""
_RESAMPLED = _P + """, w AS (""" + bootstrap.group_weights_sql("p", "sequence_id", 50) + """),
    res AS (SELECT resample, attribute, sum(CASE WHEN label = pred THEN weight ELSE 0 END) / sum(weight) AS accuracy
            FROM p JOIN w USING (sequence_id) WHERE label IS NOT NULL AND weight > 0 GROUP BY ALL)"""


def _policy_sql(invalid: str) -> str:
    return _P + f""", q AS (SELECT attribute, label, CASE WHEN segment_id % 5 = 0 THEN {invalid} ELSE pred END AS pred FROM p WHERE label IS NOT NULL)
        SELECT attribute, count(pred) AS n, round(sum((label = pred)::INT) / count(pred), 6) AS accuracy FROM q WHERE pred IS NOT NULL GROUP BY attribute"""


QUERIES = {
    "softmax_argmax": (softmax_argmax, _P + " SELECT segment_id, attribute, pred::INT AS pred, round(list_max(probs), 6) AS confidence FROM p"),
    "confusion_cells": (confusion_cells, _CELLS + " SELECT attribute, label, pred::INT AS pred, n FROM cells"),
    "class_metrics": (class_metrics, _CLASSES + """ SELECT attribute, class::INT AS class, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp,
        round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, round(iou, 6) AS iou FROM scored"""),
    "attribute_metrics": (attribute_metrics, _CLASSES + _METRICS),
    "support_metrics": (support_metrics, _CLASSES + " SELECT attribute, count(*) FILTER (support >= 40) AS classes_supported, round(avg(f) FILTER (support >= 40), 6) AS mf1_supported FROM scored GROUP BY attribute"),
    "attribute_averages": (attribute_averages, _CLASSES + f", m AS ({_METRICS.replace(', 6)', ', 12)')}) SELECT round(avg(accuracy), 6) AS aaccuracy, round(avg(mf1), 6) AS amf1, round(avg(mcc), 6) AS amcc FROM m"),
    "prob_metrics": (prob_metrics, _SUMS + " SELECT attribute, round(sum(nll) / sum(support), 6) AS nll, round(sum(brier) / sum(support), 6) AS brier, round(avg(nll / support), 6) AS mnll, round(avg(brier / support), 6) AS mbrier FROM sums GROUP BY attribute"),
    "class_nll": (class_nll, _SUMS + " SELECT attribute, label::INT AS label, support, round(nll / support, 6) AS cnll, round(brier / support, 6) AS cbrier FROM sums"),
    "null_policy_first_class": (_policy("first_class"), _policy_sql("0")),
    "null_policy_exclude": (_policy("exclude"), _policy_sql("NULL")),
    "outcome_matrix": (outcome_matrix, _P + " SELECT attribute, label, CASE WHEN segment_id % 5 = 0 THEN -1 ELSE pred END::INT AS outcome, count(*) AS n FROM p WHERE label IS NOT NULL GROUP BY ALL"),
    "bootstrap_weights_det": (bootstrap_weights_det, _RESAMPLED + " SELECT resample, attribute, round(accuracy, 6) AS accuracy FROM res"),
    "percentile_interval": (percentile_interval, _RESAMPLED + " SELECT attribute, round(quantile_cont(accuracy, 0.025), 6) AS low, round(quantile_cont(accuracy, 0.975), 6) AS high, count(*) FILTER (accuracy IS NULL) AS undefined FROM res GROUP BY attribute"),
    "paired_difference": (paired_difference, _RESAMPLED + """, d AS (SELECT a.accuracy - b.accuracy AS v FROM res a JOIN res b USING (resample) WHERE a.attribute = 'surface' AND b.attribute = 'width'),
        i AS (SELECT quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(*) FILTER (v IS NULL) AS undefined FROM d)
        SELECT 'surface-width' AS pair, round(low, 6) AS low, round(high, 6) AS high, undefined, CASE WHEN low > 0 THEN 'a' WHEN high < 0 THEN 'b' ELSE 'none' END AS better FROM i"""),
    "method_mean": (method_mean, _P + """, m AS (SELECT attribute, segment_id % 3 AS model, sum((label = pred)::INT) / count(*) AS v FROM p WHERE label IS NOT NULL GROUP BY ALL)
        SELECT attribute, round(avg(v), 6) AS mean, count(*) AS models FROM m GROUP BY attribute"""),
    "ensemble_mean": (ensemble_mean, _P + """, x AS (SELECT segment_id, CASE attribute WHEN 'surface' THEN 1.0 WHEN 'width' THEN 3.0 ELSE 0.5 END::DOUBLE AS w, probs FROM p WHERE segment_id % 11 <> 0),
        y AS (SELECT segment_id, w, unnest(probs) AS pr, generate_subscripts(probs, 1) - 1 AS class FROM x)
        SELECT segment_id, class::INT AS class, round(sum(w * pr) / sum(w), 6) AS p FROM y GROUP BY ALL
        UNION ALL SELECT DISTINCT segment_id, NULL, NULL FROM p WHERE segment_id % 11 = 0"""),
    "vote_share": (vote_share, _P + " SELECT segment_id, pred::INT AS class, count(*) AS votes, round(count(*) / sum(count(*)) OVER (PARTITION BY segment_id), 6) AS share FROM p GROUP BY segment_id, pred"),
    "key_intersection": (key_intersection, _P + " SELECT segment_id FROM p WHERE label IS NOT NULL GROUP BY segment_id HAVING count(DISTINCT attribute) = 3"),
}
