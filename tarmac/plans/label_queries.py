"""Queries of vocabularies, labels and ordinals. ``events`` stand for segments with two coded attributes, ``orders`` for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import annotations as an
from tarmac.operators import labels, tracks
from tarmac.plans.annotation_queries import _t
from tarmac.plans.scoring_queries import _P, predictions, rounded
from tarmac.plans.track_queries import _PTS, _points

#: Classes of the stand-in attributes; code 4 of ``user`` and 1 and 3 of ``step`` are no class.
CLASSES = {"user": {"low": 3, "mid": 1, "high": 0, "top": 2}, "step": {"none": 0, "far": 4, "near": 2}}


def _long(spark, sf_dir):
    pair = [F.struct(F.lit("user").alias("attribute"), F.when(F.col("event_id") % 9 != 0, F.col("user_id") % 5).cast("int").alias("code")), F.struct(F.lit("step").alias("attribute"), (F.col("event_id") % 5).cast("int").alias("code"))]
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("segment"), F.explode(F.array(*pair)).alias("x")).select("segment", "x.*")


def class_indices(spark, sf_dir):
    return labels.class_indices(_long(spark, sf_dir), labels.vocabulary(spark, CLASSES)).select("segment", "attribute", "code", "class_idx")


def unknown_codes(spark, sf_dir):
    return labels.unknown_codes(_long(spark, sf_dir), labels.vocabulary(spark, CLASSES))


def predicted_codes(spark, sf_dir):
    classes = labels.vocabulary(spark, {a: {str(i): i * 7 % 10 for i in range(10)} for a in ("surface", "width", "curve")})
    p = predictions(spark, sf_dir).withColumn("pred", F.when(F.col("segment_id") % 5 != 0, F.col("pred")))
    return labels.predicted_codes(p, classes, "pred").select("segment_id", "attribute", "code")


def _labels(strict, places=("user", "step")):
    def run(spark, sf_dir):
        segments = _t(spark, sf_dir, "events").select(F.col("event_id").alias("segment"))
        vocab = labels.restricted(labels.vocabulary(spark, CLASSES), places)
        made = labels.segment_labels(segments, _long(spark, sf_dir), vocab, "segment", strict)
        return made.select("segment", F.array_join(F.col("labels").cast("array<string>"), " ", "-").alias("labels"))

    return run


def evaluated_attributes(spark, sf_dir):
    vocab = labels.vocabulary(spark, CLASSES | {"unused": {"none": 0}})
    long = labels.class_indices(_long(spark, sf_dir), vocab)
    return labels.evaluated_attributes(long, vocab, ["step", "unused", "absent"])


def unlabeled_splits(spark, sf_dir):
    split = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("unlabeled_"), F.col("o_orderpriority"))).otherwise(F.lower("o_orderpriority"))
    return _t(spark, sf_dir, "orders").select(split.alias("split")).where(labels.is_unlabeled(F.col("split"))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def segment_locations(spark, sf_dir):
    has, value = F.col("event_id") % 3, F.col("value")
    flat = F.when(has == 0, F.struct(F.col("event_type").alias("section"), value.alias("distance_km"), F.lit(0.1).alias("length_km"), F.lit(45.5).alias("lat"), F.lit(16.5).alias("lon")))
    text = value.cast("decimal(18,4)").cast("string")
    fields = F.when(has == 1, F.struct(F.col("user_id").alias("Section"), text.alias("Distance"), F.lit("0.25").alias("Length"), F.lit("44").alias("Latitude"), F.lit("15").alias("Longitude")))
    e = _t(spark, sf_dir, "events").select("event_id", flat.alias("flat"), fields.alias("fields"))
    at = e.select("event_id", labels.location(F.col("flat"), F.col("fields")).alias("at")).select("event_id", "at.*")
    return rounded(at)


def unlabelled_orders(spark, sf_dir):
    images = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"))
    return images.join(_t(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("segment")), "segment", "left_anti")


def _members(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("attribute"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), F.col("l_partkey").alias("tie"), F.array(q % 2, q % 3, F.lit(1)).alias("codes"))


def first_codes(spark, sf_dir):
    return labels.first_codes(_members(spark, sf_dir).withColumn("turn", F.struct("member", "tie", "codes")), "turn").select("attribute", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


def differing_codes(spark, sf_dir):
    m = labels.differing_codes(_members(spark, sf_dir).withColumn("turn", F.struct("member", "tie", "codes")), "turn")
    return m.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first_member"))


def macro_prf(spark, sf_dir):
    p = predictions(spark, sf_dir).where("label is not null")
    return rounded(labels.macro_prf(p, "attribute", "label", "pred"))


def rows_from_the_end(spark, sf_dir):
    return labels.sliced(_t(spark, sf_dir, "customer"), "c_custkey", -100, None, 7).select("ordinal", "c_custkey")


def rows_backwards(spark, sf_dir):
    return labels.sliced(_t(spark, sf_dir, "orders"), "o_orderkey", None, 10, -3).select("ordinal", "o_orderkey")


def exact_split(spark, sf_dir):
    return labels.exact_split(_t(spark, sf_dir, "orders"), "o_orderkey", ratio=0.37).select("o_orderkey", "first")


def weight_errors(spark, sf_dir):
    weight = F.when(F.col("l_quantity") != 7, F.col("l_discount") - 0.02)
    m = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("member"), weight.alias("weight"))
    return labels.weight_errors(m, "l_orderkey", "member", "weight")


def differing_keys(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag")
    return labels.differing_keys(v.withColumn("model", F.col("l_linestatus")), "l_suppkey", "model", "l_returnflag")


def multi_model_methods(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("models")).where("models > 1")


def scored_attributes(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("place"))


def sampling_rates(spark, sf_dir):
    return rounded(tracks.sampling_rate(_points(spark, sf_dir), "track_id", "t"))


def courses(spark, sf_dir):
    return rounded(tracks.course(_points(spark, sf_dir), "track_id", "t", "lon", "lat").select("track_id", "t", "course"))


def recording_centroids(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment"), F.col("c_nationkey").alias("recording"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")).alias("lat"))
    return rounded(an.centroids(c, "recording", ["lat"]).drop("n"))


_V = """WITH v(attribute, place, class_idx, code) AS (VALUES ('user', 0, 0, 3), ('user', 0, 1, 1), ('user', 0, 2, 0), ('user', 0, 3, 2), ('step', 1, 0, 0), ('step', 1, 1, 4), ('step', 1, 2, 2)),
    long AS (SELECT event_id AS segment, 'user' AS attribute, CASE WHEN event_id % 9 <> 0 THEN user_id % 5 END::INT AS code FROM events UNION ALL SELECT event_id, 'step', (event_id % 5)::INT FROM events),
    found AS (SELECT l.*, v.class_idx FROM long l LEFT JOIN v USING (attribute, code))"""
_M = """WITH m AS (SELECT l_suppkey AS attribute, l_orderkey * 10 + l_linenumber AS member, l_partkey AS tie, [l_quantity::INT % 2, l_quantity::INT % 3, 1] AS codes FROM lineitem),
    f AS (SELECT attribute, codes AS expected FROM m QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY member, tie, codes) = 1)"""
_LABELS = _V + ", w AS (SELECT segment, max(class_idx) FILTER (attribute = 'user') AS a, max(class_idx) FILTER (attribute = 'step') AS b FROM found GROUP BY segment) SELECT segment, {} AS labels FROM w"

QUERIES = {
    "class_indices": (class_indices, _V + " SELECT segment, attribute, code, class_idx FROM found"),
    "unknown_codes": (unknown_codes, _V + " SELECT attribute, code, count(*) AS n FROM found WHERE code IS NOT NULL AND class_idx IS NULL GROUP BY ALL"),
    "predicted_codes": (predicted_codes, _P + " SELECT segment_id, attribute, CASE WHEN segment_id % 5 <> 0 THEN pred * 7 % 10 END::INT AS code FROM p"),
    "labels_lenient": (_labels(False), _LABELS.format("coalesce(a::VARCHAR, '-') || ' ' || coalesce(b::VARCHAR, '-')")),
    "labels_strict": (_labels(True), _LABELS.format("a || ' ' || b") + " WHERE a IS NOT NULL AND b IS NOT NULL"),
    "labels_restricted": (_labels(True, ("step",)), _LABELS.format("b::VARCHAR") + " WHERE b IS NOT NULL"),
    "evaluated_attributes": (evaluated_attributes, _V + " SELECT attribute, 1 AS place, count(*) AS n FROM found WHERE attribute = 'step' AND class_idx IS NOT NULL GROUP BY attribute"),
    "unlabeled_splits": (unlabeled_splits, "SELECT 'unlabeled_' || o_orderpriority AS split, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL GROUP BY 1"),
    "segment_locations": (segment_locations, """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR END AS section, round(CASE event_id % 3 WHEN 0 THEN 1000 * value WHEN 1 THEN 1000 * value::DECIMAL(18,4)::DOUBLE END, 6) AS distance_m,
        CASE event_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 250.0 END::DOUBLE AS length_m, CASE event_id % 3 WHEN 0 THEN 45.5 WHEN 1 THEN 44.0 END::DOUBLE AS lat, CASE event_id % 3 WHEN 0 THEN 16.5 WHEN 1 THEN 15.0 END::DOUBLE AS lon FROM events"""),
    "unlabelled_orders": (unlabelled_orders, "SELECT o_orderkey AS segment FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)"),
    "first_codes": (first_codes, _M + " SELECT attribute, array_to_string(expected, ' ') AS codes FROM f"),
    "differing_codes": (differing_codes, _M + " SELECT attribute, count(*) AS n, min(member) AS first_member FROM m JOIN f USING (attribute) WHERE list_sort(list_distinct(codes)) <> list_sort(list_distinct(expected)) GROUP BY attribute"),
    "macro_prf": (macro_prf, _P + """, s AS (SELECT attribute, label AS code, 1 AS s, 0 AS q, (label = pred)::INT AS t FROM p WHERE label IS NOT NULL UNION ALL SELECT attribute, pred, 0, 1, 0 FROM p WHERE label IS NOT NULL),
        c AS (SELECT attribute, code, sum(s) AS s, sum(q) AS q, sum(t) AS t FROM s GROUP BY ALL)
        SELECT attribute, round(avg(coalesce(t / nullif(q, 0), 0)), 6) AS macro_precision, round(avg(coalesce(t / nullif(s, 0), 0)), 6) AS macro_recall, round(avg(2 * t / (s + q)), 6) AS macro_f1 FROM c GROUP BY attribute"""),
    "rows_from_the_end": (rows_from_the_end, "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal, count(*) OVER () AS n FROM customer) SELECT ordinal, c_custkey FROM o WHERE ordinal >= greatest(n - 100, 0) AND (ordinal - greatest(n - 100, 0)) % 7 = 0"),
    "rows_backwards": (rows_backwards, "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders) SELECT ordinal, o_orderkey FROM o WHERE ordinal > 10 AND (n - 1 - ordinal) % 3 = 0"),
    "exact_split": (exact_split, "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders) SELECT o_orderkey, ordinal < round_even(0.37 * n, 0) AS first FROM o"),
    "weight_errors": (weight_errors, """WITH m AS (SELECT l_orderkey, l_partkey % 20 AS member, CASE WHEN l_quantity <> 7 THEN l_discount - 0.02::DOUBLE END AS weight FROM lineitem)
        SELECT DISTINCT l_orderkey, member, 'weight' AS error FROM m WHERE weight IS NULL OR weight <= 0 UNION ALL SELECT l_orderkey, member, 'repeated' FROM m GROUP BY ALL HAVING count(*) > 1"""),
    "differing_keys": (differing_keys, """WITH o AS (SELECT l_suppkey, count(DISTINCT l_linestatus) AS "of" FROM lineitem GROUP BY 1), k AS (SELECT l_suppkey, l_returnflag, count(DISTINCT l_linestatus) AS models FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, l_returnflag, models, "of" FROM k JOIN o USING (l_suppkey) WHERE models < "of" """),
    "multi_model_methods": (multi_model_methods, "SELECT o_orderstatus, o_custkey, count(*) AS models FROM orders GROUP BY ALL HAVING count(*) > 1"),
    "scored_attributes": (scored_attributes, "SELECT event_type, min(event_id) AS place FROM events GROUP BY 1"),
    "sampling_rates": (sampling_rates, _PTS + " SELECT track_id, round((count(*) - 1) / nullif(max(t) - min(t), 0), 6) AS rate FROM pts GROUP BY track_id"),
    "courses": (courses, _PTS + ", n AS (SELECT track_id, t, atan2(lead(lat) OVER w - lat, lead(lon) OVER w - lon) AS c FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t)) SELECT track_id, t, round(coalesce(c, lag(c) OVER (PARTITION BY track_id ORDER BY t)), 6) AS course FROM n"),
    "recording_centroids": (recording_centroids, "SELECT c_nationkey AS recording, round(median(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 6) AS lat FROM customer GROUP BY 1"),
}
