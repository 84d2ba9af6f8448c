"""Queries on annotation tables: ``lineitem`` stands for annotations, ``events`` for labelled segments, ``orders`` for splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.operators import annotations as an
from tarmac.plans.scoring_queries import rounded


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_parser(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("k"), F.lit(".0"))).when(F.col("event_id") % 5 == 1, F.concat(F.col("k"), F.lit(" m"))).when(F.col("event_id") % 5 == 2, F.col("event_type")).when(F.col("event_id") % 5 == 3, F.concat(F.lit("-"), F.col("k"))).otherwise(F.col("k"))
    e = e.withColumn("cell", cell)
    return e.select("event_id", codes.code(F.col("cell")).alias("code"), codes.lenient_int(F.col("cell")).alias("lenient"), codes.lenient_float(F.col("cell")).alias("number"), codes.is_bad_code(F.col("cell")).alias("bad"))


_CELL = """WITH c AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events),
    d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN k || '.0' WHEN 1 THEN k || ' m' WHEN 2 THEN event_type WHEN 3 THEN '-' || k ELSE k END AS cell FROM c)"""


def bucket_codes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", codes.bucket(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")), [300000, 200000, 100000, 50000, 20000, 5000]).alias("code"))


def segment_id_parser(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", codes.segment_id(F.col("url")).alias("segment_id"))


def timecodes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat((F.col("event_id") % 4).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":07"))).when(F.col("event_id") % 3 == 1, F.concat((F.col("event_id") % 90).cast("string"), F.lit(":30"))).otherwise(F.col("event_type"))
    return e.select("event_id", codes.timecode(text).alias("seconds"))


def drop_reasons(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    rules = [("large_quantity", F.col("l_quantity") > 45), ("bad_discount", F.abs(F.col("l_discount") - 0.05) > 0.04 + 1e-6), ("returned", F.col("l_returnflag") == "R")]
    return an.drop_report(li.withColumn("drop_reason", codes.first_reason(rules)), by=["l_linestatus"])


def _annotations(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("segment"), (F.col("l_suppkey") % 3).alias("annotator"), F.ascii("l_returnflag").alias("code"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")


_ANN = "WITH a AS (SELECT l_orderkey || '-' || l_linenumber AS segment, l_suppkey % 3 AS annotator, ascii(l_returnflag) AS code, * FROM lineitem)"


def dedup_most_filled(spark, sf_dir):
    filled = F.size(F.filter(F.array(F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0))), lambda c: c.isNotNull()))
    best = an.most_filled(_annotations(spark, sf_dir), ["segment"], filled, ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount"])
    return best.select("segment", "l_partkey", "l_suppkey")


def annotator_pairs(spark, sf_dir):
    return an.annotator_pairs(_annotations(spark, sf_dir), "segment", "annotator", "code")


def cohen_kappa(spark, sf_dir):
    return rounded(an.kappa(annotator_pairs(spark, sf_dir), ["a", "b"]))


def conflicts_topn(spark, sf_dir):
    return an.conflicts(_annotations(spark, sf_dir), "segment", "code", 20)


def _labelled(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("sequence_id"), "event_type", "value", F.element_at(F.array(*map(F.lit, ("train", "train", "train", "val", "test"))), (F.col("user_id") % 5 + 1).cast("int")).alias("split"))


_LAB = "WITH l AS (SELECT event_id, user_id AS sequence_id, event_type, value, CASE user_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM events)"
_DIST = _LAB + ", d AS (SELECT split, event_type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM l GROUP BY split, event_type)"


def _dist(spark, sf_dir):
    return an.distribution(_labelled(spark, sf_dir), ["split"], "event_type")


def class_distribution(spark, sf_dir):
    return rounded(_dist(spark, sf_dir))


def class_balance(spark, sf_dir):
    return rounded(an.balance(_dist(spark, sf_dir), ["split"]))


def label_counts(spark, sf_dir):
    return an.label_counts(_dist(spark, sf_dir), ["split"])


def tv_distance(spark, sf_dir):
    d = _dist(spark, sf_dir)
    return rounded(an.variation_distance(d.where("split = 'train'"), d.where("split = 'val'"), "event_type"))


def majority_transfer(spark, sf_dir):
    d = _dist(spark, sf_dir)
    train = d.where("split = 'train'").withColumn("attribute", F.lit("type"))
    return rounded(an.majority_transfer(train, d.where("split = 'test'").withColumn("attribute", F.lit("type")), ["attribute"], "event_type"))


def rare_classes(spark, sf_dir):
    return rounded(_dist(spark, sf_dir).where("share > 0 and share < 0.2"))


def coverage_by_split(spark, sf_dir):
    return an.class_coverage(_labelled(spark, sf_dir), "event_type", "split", "sequence_id", 30)


def coverage_pivot(spark, sf_dir):
    c = an.class_coverage(_labelled(spark, sf_dir), "event_type", "split", "sequence_id", 30)
    return c.groupBy("event_type").pivot("split", ["train", "val", "test"]).agg(F.sum("segments"))


def majority_vote_split(spark, sf_dir):
    e = _labelled(spark, sf_dir).withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("event_id") % 3 + 1).cast("int")))
    return an.majority_split(e, "sequence_id", "split", {"train": 0, "val": 1, "test": 2})


def overview_grouping_sets(spark, sf_dir):
    lengths = _labelled(spark, sf_dir).groupBy("split", "sequence_id").agg(F.count(F.lit(1)).alias("length")).withColumn("part", F.col("sequence_id") % 2)
    return rounded(an.overview(lengths, "split", "part", "length"))


def selection_statistics(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("segments"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull() & F.col("toxic").isNull()).alias("all_missing"), F.sum("toxic").alias("toxic"))


def _old_new(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return o.where("key % 10 <> 1"), o.where("key % 10 <> 2").withColumn("value", F.when(F.col("key") % 7 == 0, F.lit("new")).otherwise(F.col("value")))


def mapping_diff(spark, sf_dir):
    return an.mapping_difference(*_old_new(spark, sf_dir), "key", "value")


def group_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), F.col("o_custkey").alias("grp"))
    new = o.withColumn("grp", F.when(F.col("segment") % 4 == 0, F.col("grp") + 100000).otherwise(F.col("grp")))
    return an.regroupings(o, new, "segment", "grp")


QUERIES = {
    "code_parser": (code_parser, _CELL + r""" SELECT event_id, CASE WHEN regexp_matches(cell, '^-?\d{1,9}$') AND cell::INT >= 0 THEN cell::INT END AS code,
        CASE WHEN regexp_matches(cell, '^[+-]?\d+(\.\d*)?$') THEN CASE WHEN cell::DOUBLE = floor(cell::DOUBLE) THEN cell::DOUBLE::INT END ELSE nullif(regexp_extract(cell, '^(\d{1,9}) ', 1), '')::INT END AS lenient,
        CASE WHEN regexp_matches(cell, '^[+-]?\d+(\.\d*)?$') THEN cell::DOUBLE END AS number, cell IS NOT NULL AND NOT regexp_matches(cell, '^(-?\d{1,9}|None|)$') AS bad FROM d"""),
    "bucket_codes": (bucket_codes, "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_totalprice >= 300000 THEN 1 WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 3 WHEN o_totalprice >= 50000 THEN 4 WHEN o_totalprice >= 20000 THEN 5 WHEN o_totalprice >= 5000 THEN 6 ELSE 7 END AS code FROM orders"),
    "segment_id_parser": (segment_id_parser, r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(?:seg_|id=)(\d+)', 1), ''), nullif(regexp_extract(url, '(\d{4,})', 1), '')) AS segment_id FROM pages"),
    "timecodes": (timecodes, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 4) * 3600 + (event_id % 60) * 60 + 7 WHEN 1 THEN (event_id % 90) * 60 + 30 END::DOUBLE AS seconds FROM events"),
    "drop_reasons": (drop_reasons, "SELECT l_linestatus, CASE WHEN l_quantity > 45 THEN 'large_quantity' WHEN abs(l_discount - 0.05::DOUBLE) > 0.04::DOUBLE + 1e-6::DOUBLE THEN 'bad_discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS drop_reason, count(*) AS n FROM lineitem GROUP BY ALL"),
    "dedup_most_filled": (dedup_most_filled, _ANN + " SELECT segment, l_partkey, l_suppkey FROM a QUALIFY row_number() OVER (PARTITION BY segment ORDER BY (l_tax <> 0)::INT + (l_discount <> 0)::INT DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) = 1"),
    "annotator_pairs": (annotator_pairs, _ANN + ", o AS (SELECT segment, annotator, min(code) AS code FROM a GROUP BY ALL) SELECT x.annotator AS a, y.annotator AS b, x.code AS code_a, y.code AS code_b, count(*) AS n FROM o x JOIN o y USING (segment) WHERE x.annotator <> y.annotator GROUP BY ALL"),
    "cohen_kappa": (cohen_kappa, _ANN + """, o AS (SELECT segment, annotator, min(code) AS code FROM a GROUP BY ALL), p AS (SELECT x.annotator AS a, y.annotator AS b, x.code AS ca, y.code AS cb FROM o x JOIN o y USING (segment) WHERE x.annotator <> y.annotator),
        t AS (SELECT a, b, count(*) AS n, count(*) FILTER (ca = cb) AS same FROM p GROUP BY a, b), ma AS (SELECT a, b, ca AS code, count(*) AS na FROM p GROUP BY ALL), mb AS (SELECT a, b, cb AS code, count(*) AS nb FROM p GROUP BY ALL),
        c AS (SELECT a, b, sum(na * nb) AS chance FROM ma JOIN mb USING (a, b, code) GROUP BY a, b)
        SELECT a, b, n, round(same / n, 6) AS agreement, round((same::DOUBLE * n - chance) / nullif(n::DOUBLE * n - chance, 0), 6) AS kappa FROM t JOIN c USING (a, b)"""),
    "conflicts_topn": (conflicts_topn, _ANN + ", c AS (SELECT segment, count(DISTINCT code) AS codes FROM a GROUP BY segment HAVING count(DISTINCT code) > 1) SELECT segment, codes, (SELECT count(*) FROM c) AS total FROM c ORDER BY codes DESC, segment LIMIT 20"),
    "class_distribution": (class_distribution, _DIST + " SELECT split, event_type, n, round(share, 6) AS share FROM d"),
    "class_balance": (class_balance, _DIST + " SELECT split, sum(n)::BIGINT AS n, count(*) AS classes, round(max(share), 6) AS majority_share, round(max(n) / min(n), 6) AS imbalance, round(exp(-sum(share * ln(share))), 6) AS effective_classes FROM d GROUP BY split"),
    "label_counts": (label_counts, _DIST + " SELECT split, sum(n)::BIGINT AS segments, count(*) AS classes, min(n) AS smallest FROM d GROUP BY split"),
    "tv_distance": (tv_distance, _DIST + " SELECT round(0.5 * sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))), 6) AS distance FROM (SELECT * FROM d WHERE split = 'train') a FULL JOIN (SELECT * FROM d WHERE split = 'val') b USING (event_type)"),
    "majority_transfer": (majority_transfer, _DIST + ", m AS (SELECT event_type FROM d WHERE split = 'train' ORDER BY n DESC, event_type LIMIT 1) SELECT 'type' AS attribute, event_type, round(coalesce(share, 0), 6) AS accuracy FROM m LEFT JOIN (SELECT * FROM d WHERE split = 'test') USING (event_type)"),
    "rare_classes": (rare_classes, _DIST + " SELECT split, event_type, n, round(share, 6) AS share FROM d WHERE share < 0.2"),
    "coverage_by_split": (coverage_by_split, _LAB + " SELECT event_type, split, count(*) AS segments, count(DISTINCT sequence_id) AS sequences, count(DISTINCT sequence_id) < 30 AS short FROM l GROUP BY ALL"),
    "coverage_pivot": (coverage_pivot, _LAB + " SELECT event_type, nullif(count(*) FILTER (split = 'train'), 0) AS train, nullif(count(*) FILTER (split = 'val'), 0) AS val, nullif(count(*) FILTER (split = 'test'), 0) AS test FROM l GROUP BY event_type"),
    "majority_vote_split": (majority_vote_split, "WITH s AS (SELECT user_id AS sequence_id, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, event_id % 3 AS r, count(*) AS n FROM events GROUP BY ALL) SELECT sequence_id, split, count(*) OVER (PARTITION BY sequence_id) > 1 AS conflict FROM s QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, r) = 1"),
    "overview_grouping_sets": (overview_grouping_sets, _LAB + ", s AS (SELECT split, sequence_id, count(*) AS length, sequence_id % 2 AS part FROM l GROUP BY ALL) SELECT split, part, count(*) AS n, sum(length)::BIGINT AS total, min(length) AS shortest, round(quantile_cont(length, 0.5), 6) AS median, max(length) AS longest FROM s GROUP BY ROLLUP (split, part)"),
    "selection_statistics": (selection_statistics, "SELECT source, count(*) AS segments, count(quality) AS labelled, count(*) FILTER (quality IS NULL AND toxic IS NULL) AS all_missing, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"),
    "mapping_diff": (mapping_diff, "WITH o AS (SELECT o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderkey % 10 <> 1), n AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 10 <> 2) SELECT key, CASE WHEN n.value IS NULL THEN 'removed' WHEN o.value IS NULL THEN 'added' ELSE 'changed' END AS kind, o.value AS old, n.value AS new FROM o FULL JOIN n USING (key) WHERE o.value IS DISTINCT FROM n.value"),
    "group_diff": (group_diff, "SELECT o_custkey AS old_group, count(DISTINCT o_orderkey % 4 = 0) AS new_groups, count(*) AS segments FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 4 = 0) > 1"),
}
