"""Queries of templates and of files that are to be written: ``lineitem`` gives codes, ``orders`` segments and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import templates
from tarmac.plans.annotation_queries import _t

_TEMPLATE = templates.Template(("id", "section", "km", "image", "flag", "status", "surface"), {"segment_id": "id", "section": "section", "distance": "km", "image": "image"}, {"returned": "flag", "state": "status", "paved": "surface"})


def _codes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.ascii(c).alias("code")) for n, c in (("returned", "l_returnflag"), ("state", "l_linestatus"))], F.struct(F.lit("number").alias("attribute"), F.col("l_linenumber").cast("int").alias("code")))
    return li.select(F.col("l_orderkey").alias("segment_id"), F.inline(pairs))


def template_table(spark, sf_dir):
    """The coding table of all orders in the template's columns; images and surfaces stay blank."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("road_id"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("section"), (F.col("o_custkey") % 10).alias("distance"))
    return templates.fill(_TEMPLATE, o, _codes(spark, sf_dir))


def template_coverage(spark, sf_dir):
    return templates.coverage(_TEMPLATE, _codes(spark, sf_dir))


def path_clashes(spark, sf_dir):
    """Models whose files would be written to one path."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_brand"), F.lit("/"), F.substring("p_name", 1, 3)).alias("path"))
    return templates.clashes(p, "p_partkey", "path").select("path", F.array_join("models", ",").alias("models"), "n")


def prediction_misfits(spark, sf_dir):
    """Line items as predictions of a model per supplier for the segments of a split, against orders and a vocabulary."""
    predicted = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("model"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("split"), F.col("l_orderkey").alias("segment_id"), F.col("l_linestatus").alias("attribute"), F.when(F.col("l_tax") > 0, F.ascii("l_returnflag")).alias("code"))
    words = spark.createDataFrame([("O", ord("N")), ("O", ord("A"))], "attribute string, code int")
    members = _t(spark, sf_dir, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("split"), F.col("o_orderkey").alias("segment_id"))
    return templates.misfits(predicted, words, members)


QUERIES = {
    "template_table": (template_table, """SELECT o_custkey AS road_id, o_orderkey AS place, o_orderkey::VARCHAR AS id, o_orderstatus AS section, (o_custkey % 10)::VARCHAR AS km, NULL AS image,
        (SELECT min(ascii(l_returnflag))::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey) AS flag, (SELECT min(ascii(l_linestatus))::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey) AS status, NULL AS surface FROM orders"""),
    "template_coverage": (template_coverage, "SELECT 'number' AS name, 'unmapped' AS kind, count(*) AS n FROM lineitem UNION ALL SELECT 'surface', 'unfilled', 0"),
    "path_clashes": (path_clashes, "SELECT lower(p_brand || '/' || p_name[1:3]) AS path, string_agg(DISTINCT p_partkey, ',' ORDER BY p_partkey) AS models, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1"),
    "prediction_misfits": (prediction_misfits, """WITH p AS (SELECT l_suppkey % 4 AS model, 's' || (l_suppkey % 4) AS split, l_orderkey AS seg, l_linestatus AS a, CASE WHEN l_tax > 0 THEN l_returnflag END AS c FROM lineitem),
        m AS (SELECT DISTINCT 's' || (o_custkey % 3) AS split, o_orderkey AS seg FROM orders),
        t AS (SELECT DISTINCT model, split, seg FROM p WHERE split IN (SELECT split FROM m))
        SELECT model, 'split' AS reason, split AS name, count(*) AS n FROM p WHERE split NOT IN (SELECT split FROM m) GROUP BY ALL
        UNION ALL SELECT model, 'attribute', a, count(*) FROM p WHERE a <> 'O' GROUP BY ALL
        UNION ALL SELECT model, 'code', a, count(*) FROM p WHERE a = 'O' AND c NOT IN ('N', 'A') GROUP BY ALL
        UNION ALL SELECT model, 'segments', split, count(*) FROM t WHERE (split, seg) NOT IN (SELECT (split, seg) FROM m) GROUP BY ALL
        UNION ALL SELECT model, 'missing', split, count(*) FROM (SELECT DISTINCT model, split FROM t) JOIN m USING (split) WHERE (model, split, seg) NOT IN (SELECT (model, split, seg) FROM t) GROUP BY ALL"""),
}
