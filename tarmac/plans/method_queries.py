"""Queries of methods, validation rules and texts. ``orders`` stand for models, customers for methods, ``lineitem`` for members."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import frames, text
from tarmac.operators import annotations as an
from tarmac.operators import comparison, roads, validation
from tarmac.plans.annotation_queries import _t
from tarmac.plans.scoring_queries import rounded


def share_texts(spark, sf_dir):
    x = (F.col("o_orderkey") % 998) / 997.0
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.share_text(x).alias("share"), text.ratio_text(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / F.when(F.col("o_orderkey") % 2 == 0, 97.0).otherwise(9973.0))).alias("ratio"))


def metric_texts(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 2001 - 1000) / 997.0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.metric_text(x, 3).alias("plain"), text.metric_text(x, 2, signed=True).alias("signed"))


def offset_texts(spark, sf_dir):
    k = (F.col("event_id") % 5 + 1).cast("int")
    offsets = F.when(F.col("event_id") % 3 == 0, F.sequence(-k, k)).when(F.col("event_id") % 3 == 1, F.array(k, k + 2, k + 3)).otherwise(F.array(k))
    return _t(spark, sf_dir, "events").select("event_id", text.offsets_text(offsets).alias("offsets"))


def form_values(spark, sf_dir):
    kind = F.col("event_id") % 4
    typed = F.when(kind == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("  "))).when(kind == 1, F.concat_ws(" ", F.col("user_id").cast("string"), F.lit("0.5"))).when(kind == 2, F.lit("  ")).otherwise(F.col("event_type"))
    e = _t(spark, sf_dir, "events").select("event_id", typed.alias("x"), "event_type")
    e = e.select("event_id", text.seed(F.col("x")).alias("s"), text.typed(F.col("x")).alias("m"), text.summary(F.concat(F.lit("\n  "), F.col("event_type"), F.lit(" one \nmore"))).alias("summary"))
    return e.select("event_id", F.col("s.value").alias("seed"), F.col("s.bad").alias("bad"), F.col("m.number").alias("number"), F.array_join(F.col("m.numbers").cast("array<decimal(9,1)>").cast("array<string>"), "/").alias("numbers"), F.col("m.text").alias("text"), "summary")


def gps_degrees(spark, sf_dir):
    sides = F.element_at(F.array(*map(F.lit, "NSEW")), (F.col("event_id") % 4 + 1).cast("int"))
    dms = F.format_string("%d deg %d' %d.%d\" %s", F.col("event_id") % 180, F.col("user_id") % 60, F.col("event_id") % 59, F.col("event_id") % 10, sides)
    return _t(spark, sf_dir, "events").select("event_id", F.round(text.degrees_of(F.when(F.col("event_id") % 13 != 0, dms).otherwise(F.col("event_type"))), 9).alias("degrees"))


def _angles(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 360).cast("double").alias("yaw"), (F.col("user_id") % 180 - 90).cast("double").alias("pitch"), F.col("value").alias("roll"))


def rotation_matrices(spark, sf_dir):
    m = _angles(spark, sf_dir).select("event_id", F.posexplode(frames.rotation_matrix(F.col("yaw"), F.col("pitch"), F.col("roll"))).alias("place", "entry"))
    return m.select("event_id", "place", (F.round("entry", 9) + 0.0).alias("entry"))


def fields_of_view(spark, sf_dir):
    h = (F.col("p_size") + 40).cast("double")
    v = frames.vertical_fov(F.lit(1.5), h)
    size = frames.flat_size(F.lit(1920.0), F.lit(1080.0) + F.col("p_size"), h, v, 0.95)
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(v, 6).alias("vertical"), F.round(frames.aspect_of(h, v), 6).alias("aspect"), size["width"].alias("width"), size["height"].alias("height"))


def axis_remap(spark, sf_dir):
    v = frames.remap(F.array("yaw", "pitch", "roll"), [2, 0, 1], [1, -1, 1])
    return _angles(spark, sf_dir).select("event_id", v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def repeated_codes(spark, sf_dir):
    return validation.repeated(_t(spark, sf_dir, "part"), ["p_brand", "p_size"])


def differing_fields(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return validation.differing(o, "o_custkey", ["o_orderstatus", "o_orderpriority"])


def outside_classes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return validation.outside(e, F.col("k") - 3, F.lit(90)).select("event_id", "k")


def _uses(spark, sf_dir):
    names = F.array(*map(F.lit, ("train", "val", "test", "other")))
    at = lambda n, k: F.element_at(names, (F.floor(F.col("o_orderkey") / n) % k + 1).cast("int"))
    o = _t(spark, sf_dir, "orders")
    training = F.when(F.col("o_orderkey") % 31 != 0, F.array(at(1, 3), at(3, 3)))
    return o.select("o_orderkey", (F.col("o_custkey") % 200).alias("ensemble"), training.alias("training"), F.array(at(7, 4)).alias("stopping"))


def split_overlaps(spark, sf_dir):
    return validation.overlapping_splits(_uses(spark, sf_dir), "o_orderkey", "training", "stopping", ["train", "val", "test"])


def ensemble_uses(spark, sf_dir):
    u = comparison.union_of_uses(_uses(spark, sf_dir), "ensemble", "training", "stopping")
    return u.select("ensemble", F.array_join("training", ",").alias("training"), F.array_join("stopping", ",").alias("stopping"))


_USES = """WITH u AS (SELECT o_orderkey, o_custkey % 200 AS ensemble, CASE WHEN o_orderkey % 31 <> 0 THEN [s[o_orderkey % 3 + 1], s[(o_orderkey // 3) % 3 + 1]] END AS training, [s[(o_orderkey // 7) % 4 + 1]] AS stopping
    FROM orders, (SELECT ['train', 'val', 'test', 'other'] AS s))"""


def road_errors(spark, sf_dir):
    segments = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment"), (F.col("p_size") > 25).alias("labelled"))
    members = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_partkey").alias("segment"), F.col("l_suppkey").alias("road"))
    return validation.road_errors(segments, members, "segment", "road")


def not_comparable(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("method"), F.col("c_mktsegment").alias("segments"), (F.col("c_nationkey") % 2).alias("attributes"), F.when(F.col("c_custkey") % 2 == 0, "exclude").otherwise("first_class").alias("policy"), (F.col("c_custkey") % 5).alias("invalid"))
    return validation.not_comparable(c, "method", ["segments", "attributes"], "policy", "invalid", 2)


def selection_errors(spark, sf_dir):
    wanted = _t(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_quantity > 40")
    return validation.selection_errors(wanted, _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


def t_quantiles(spark, sf_dir):
    p = (F.col("event_id") % 999 + 0.5) / 1000
    return _t(spark, sf_dir, "events").select("event_id", F.round(comparison.t_quantile(p, 1), 6).alias("t1"), F.round(comparison.t_quantile(p, 2), 6).alias("t2"))


def method_resamples(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("method"), (F.col("o_orderkey") % 50).alias("resample"), F.when(F.col("o_orderkey") % 401 != 0, F.col("o_totalprice")).alias("value"))
    return rounded(comparison.method_resamples(o, "method", "resample", []), 4)


_U = "((('0x' || left(sha256(concat_ws('|', method, resample, {i}, 0, '{k}')), 12))::UBIGINT)::DOUBLE + 0.5) / pow(2.0, 48)"
_N = f"sqrt(-2 * ln({_U.format(i='{i}', k='r')})) * cos(2 * pi() * {_U.format(i='{i}', k='a')})"


def not_worse_methods(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("method"), (F.col("o_totalprice") - 400000 - (F.col("o_custkey") % 40) * 2000).alias("advantage"))
    return rounded(comparison.not_worse(o, ["method"], "advantage"), 4)


def ensemble_names(spark, sf_dir):
    seed = F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderkey") % 17)
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("ensemble"), F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("method"), seed.alias("seed")).distinct()
    return comparison.member_names(o, "ensemble", "method", "seed")


def complete_splits(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    members = _t(spark, sf_dir, "customer").select((F.col("c_custkey") / 4).cast("long").alias("ensemble"), F.col("c_custkey").alias("model"))
    return comparison.complete_splits(members, o.select(F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("split")), "ensemble", "model", "split")


def scoring_states(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("fingerprint"), "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 7 == 0, "error").when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("done")
    scorings = o.where("o_orderkey % 3 <> 0").select("o_orderkey", status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("fingerprint")).alias("fingerprint"))
    return comparison.scoring_states(o, scorings, o.where("o_orderkey % 11 = 0"), "o_orderkey")


def settings_fingerprints(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", comparison.fingerprint(F.col("c_nationkey").alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("b")).alias("fingerprint"))


def redacted_reports(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return comparison.without_class_scores(o, "o_orderpriority", ["1-URGENT", "5-LOW"], ["o_totalprice"])


def subset_averages(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("line"))
    values = li.select("l_suppkey", F.concat(F.lit("a"), (F.col("l_partkey") % 5).cast("string")).alias("attribute"), F.when(F.col("l_partkey") % 4 != 0, F.col("line").cast("double")).alias("value"))
    return rounded(comparison.average_of(values, ["l_suppkey"], "attribute", ["a1", "a3", "a4"]))


def sequences_per_class(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("user_id").alias("sequences"))


def sequence_centroids(spark, sf_dir):
    return an.centroids(_t(spark, sf_dir, "events").select("user_id", "event_type", "value", (F.col("event_id") % 91).cast("double").alias("lat")), "user_id", ["lat", "value"])


def missing_classes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("code"))
    return an.missing_classes(o, "code", "o_orderpriority")


def list_differences(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    renamed = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return an.list_difference(o.select("o_custkey", "o_orderpriority"), o.select(renamed.alias("o_custkey"), "o_orderpriority"))


def first_uploads(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 30).alias("dataset"), F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("user")).agg(F.min("o_orderdate").alias("first"))
    return o.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "user"))), lambda s: s["user"]), ",").alias("submitters"))


def interleaved(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("segment"), (F.col("event_id") / 100).cast("long").alias("recording"), (F.col("event_id") % 3 == 0).alias("labelled"))
    return roads.interleave(e, "recording", "segment", "labelled", 5)


QUERIES = {
    "share_texts": (share_texts, """WITH x AS (SELECT o_orderkey, (o_orderkey % 998) / 997.0::DOUBLE AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / CASE WHEN o_orderkey % 2 = 0 THEN 97.0::DOUBLE ELSE 9973.0::DOUBLE END END AS r FROM orders)
        SELECT o_orderkey, CASE WHEN s > 0 AND s < 0.0005 THEN '<0.1%' WHEN s >= 0.9995 AND s < 1 THEN '>99.9%' ELSE printf('%.1f%%', s * 100) END AS share,
            CASE WHEN r IS NULL THEN '' WHEN r >= 10 THEN format('{:,}', round_even(r, 0)::BIGINT) ELSE printf('%.1f', r) END AS ratio FROM x"""),
    "metric_texts": (metric_texts, """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 2001 - 1000) / 997.0::DOUBLE END AS v FROM orders)
        SELECT o_orderkey, coalesce(regexp_replace(printf('%.3f', v), '^(-?)0\\.', '\\1.'), '–') AS plain, coalesce(CASE WHEN v > 0 THEN '+' ELSE '' END || regexp_replace(printf('%.2f', v), '^(-?)0\\.', '\\1.'), '–') AS signed FROM x"""),
    "offset_texts": (offset_texts, """WITH x AS (SELECT event_id, event_id % 3 AS m, event_id % 5 + 1 AS k FROM events)
        SELECT event_id, CASE m WHEN 0 THEN (-k) || '..' || k WHEN 1 THEN k || ',' || (k + 2) || ',' || (k + 3) ELSE k::VARCHAR END AS offsets FROM x"""),
    "form_values": (form_values, """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS seed, event_id % 4 IN (1, 3) AS bad, CASE WHEN event_id % 4 = 0 THEN user_id::DOUBLE END AS number,
        CASE WHEN event_id % 4 = 1 THEN user_id || '.0/0.5' END AS numbers, CASE WHEN event_id % 4 = 3 THEN event_type END AS text, event_type || ' one' AS summary FROM events"""),
    "gps_degrees": (gps_degrees, "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN round(CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END * (event_id % 180 + (user_id % 60) / 60.0::DOUBLE + ((event_id % 59) || '.' || (event_id % 10))::DOUBLE / 3600), 9) END AS degrees FROM events"),
    "rotation_matrices": (rotation_matrices, """WITH a AS (SELECT event_id, radians((event_id % 360)::DOUBLE) AS z, radians((user_id % 180 - 90)::DOUBLE) AS y, radians(value) AS x FROM events),
        m AS (SELECT event_id, [[1.0::DOUBLE, 0, 0], [0, cos(x), -sin(x)], [0, sin(x), cos(x)]] AS rx, [[cos(y), 0, sin(y)], [0, 1, 0], [-sin(y), 0, cos(y)]] AS ry, [[cos(z), -sin(z), 0], [sin(z), cos(z), 0], [0, 0, 1]] AS rz FROM a),
        i AS (SELECT m.*, r.range AS r, c.range AS c FROM m, range(3) r, range(3) c)
        SELECT event_id, (r * 3 + c)::INT AS place, round(list_sum(list_transform([1, 2, 3], lambda k: list_sum(list_transform([1, 2, 3], lambda j: rx[r + 1][j] * ry[j][k])) * rz[k][c + 1])), 9) + 0.0 AS entry FROM i"""),
    "fields_of_view": (fields_of_view, """WITH h AS (SELECT p_partkey, p_size, (p_size + 40)::DOUBLE AS h FROM part), v AS (SELECT *, 2 * degrees(atan(tan(radians(h / 2)) / 1.5)) AS v, 2 * least(960.0, (1080 + p_size) / 2) * 0.95::DOUBLE AS d FROM h)
        SELECT p_partkey, round(v, 6) AS vertical, 1.5::DOUBLE AS aspect, round_even(d * h / 360, 0)::INT AS width, round_even(d * v / 360, 0)::INT AS height FROM v"""),
    "axis_remap": (axis_remap, "SELECT event_id, value AS x, -(event_id % 360)::DOUBLE AS y, (user_id % 180 - 90)::DOUBLE AS z FROM events"),
    "repeated_codes": (repeated_codes, "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1"),
    "differing_fields": (differing_fields, """WITH o AS (SELECT o_custkey, 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END FROM orders)
        SELECT o_custkey, field, count(DISTINCT coalesce(v, '-')) AS "values" FROM o GROUP BY ALL HAVING count(DISTINCT coalesce(v, '-')) > 1"""),
    "outside_classes": (outside_classes, "WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events) SELECT event_id, k FROM e WHERE k < 3 OR k >= 93"),
    "split_overlaps": (split_overlaps, _USES + """ SELECT o_orderkey, CASE WHEN stopping[1] = 'other' THEN 'unknown split' WHEN training[1] = training[2] THEN 'split listed twice' ELSE 'split used twice' END AS error FROM u
        WHERE stopping[1] = 'other' OR training[1] = training[2] OR list_contains(training, stopping[1])"""),
    "ensemble_uses": (ensemble_uses, _USES + """, x AS (SELECT ensemble, CASE WHEN count(training) = count(*) THEN list_sort(list_distinct(flatten(list(training)))) END AS t, list_sort(list_distinct(flatten(list(stopping)))) AS s FROM u GROUP BY ensemble)
        SELECT ensemble, array_to_string(t, ',') AS training, CASE WHEN t IS NOT NULL THEN array_to_string(list_filter(s, lambda v: NOT list_contains(t, v)), ',') END AS stopping FROM x"""),
    "road_errors": (road_errors, """WITH r AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY 1)
        SELECT p_partkey AS segment, CASE WHEN n IS NULL THEN 'in no sequence' ELSE 'in several sequences' END AS error FROM part LEFT JOIN r ON l_partkey = p_partkey WHERE n IS NULL OR (p_size > 25 AND n > 1)"""),
    "not_comparable": (not_comparable, """WITH c AS (SELECT c_custkey AS method, c_mktsegment AS s, c_nationkey % 2 AS a, c_custkey % 2 = 0 AS ex, c_custkey % 5 AS i FROM customer), b AS (SELECT s AS bs, a AS ba, i AS bi FROM c WHERE method = 2)
        SELECT method, CASE WHEN s <> bs THEN 'different segments' WHEN a <> ba THEN 'different attributes' ELSE 'invalid predictions left out' END AS reason FROM c, b WHERE method <> 2 AND (s <> bs OR a <> ba OR (ex AND i + bi > 0))"""),
    "selection_errors": (selection_errors, """WITH w AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 40 GROUP BY 1), j AS (SELECT w.*, o_orderkey FROM w LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F')
        SELECT l_orderkey, CASE WHEN n > 1 THEN 'repeated' ELSE 'missing' END AS error FROM j WHERE n > 1 OR o_orderkey IS NULL"""),
    "t_quantiles": (t_quantiles, "WITH p AS (SELECT event_id, (event_id % 999 + 0.5::DOUBLE) / 1000 AS p FROM events) SELECT event_id, round(tan(pi() * (p - 0.5::DOUBLE)), 6) AS t1, round((2 * p - 1) / sqrt(2 * p * (1 - p)), 6) AS t2 FROM p"),
    "method_resamples": (method_resamples, f"""WITH g AS (SELECT o_custkey % 20 AS method, o_orderkey % 50 AS resample, count(*) AS m, count(CASE WHEN o_orderkey % 401 <> 0 THEN 1 END) AS d, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1, 2)
        SELECT method, resample, round(CASE WHEN d < m THEN NULL WHEN m = 1 THEN mean ELSE mean + sd / sqrt(m) * ({_N.format(i='0')}) / sqrt(list_sum(list_transform(range(1, m), lambda i: pow({_N.format(i='i')}, 2))) / (m - 1)) END, 4) AS value FROM g"""),
    "not_worse_methods": (not_worse_methods, """WITH g AS (SELECT o_custkey % 40 AS method, quantile_cont(o_totalprice - 400000 - (o_custkey % 40) * 2000, 0.95) AS u FROM orders GROUP BY 1) SELECT method, round(u, 4) AS upper, u >= 0 AS not_worse FROM g"""),
    "ensemble_names": (ensemble_names, """WITH o AS (SELECT DISTINCT o_custkey % 50 AS ensemble, 'm' || (o_orderkey % 3) AS method, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey % 17 END AS seed FROM orders),
        r AS (SELECT ensemble, method, min(seed) AS a, max(seed) AS b, count(*) AS n FROM (SELECT *, seed - row_number() OVER (PARTITION BY ensemble, method ORDER BY seed) AS run FROM o WHERE seed IS NOT NULL) GROUP BY ensemble, method, run),
        p AS (SELECT ensemble, method, 1 AS kind, method || CASE WHEN sum(n) = 1 THEN '_seed' ELSE '_seeds' END || string_agg(CASE WHEN n >= 3 THEN a || '-' || b WHEN n = 2 THEN a || ',' || b ELSE a::VARCHAR END, ',' ORDER BY a) AS part FROM r GROUP BY ensemble, method
              UNION ALL SELECT ensemble, method, 0, method FROM o WHERE seed IS NULL)
        SELECT ensemble, string_agg(part, '+' ORDER BY method, kind) AS name FROM p GROUP BY ensemble"""),
    "complete_splits": (complete_splits, """WITH m AS (SELECT c_custkey // 4 AS ensemble, c_custkey AS model FROM customer), s AS (SELECT DISTINCT o_custkey AS model, o_orderpriority AS split FROM orders)
        SELECT m.ensemble, split, count(*) AS members FROM m JOIN s USING (model) JOIN (SELECT ensemble, count(*) AS size FROM m GROUP BY 1) z ON z.ensemble = m.ensemble GROUP BY m.ensemble, split, size HAVING count(*) = size"""),
    "scoring_states": (scoring_states, """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'pending' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 3 = 0 OR o_orderstatus <> 'F' THEN 'unscored'
        WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'current' END AS state FROM orders"""),
    "settings_fingerprints": (settings_fingerprints, """SELECT c_custkey, sha256('{"a":' || c_nationkey || ',"b":' || CASE WHEN c_custkey % 3 <> 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}') AS fingerprint FROM customer"""),
    "redacted_reports": (redacted_reports, "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN o_totalprice END AS o_totalprice FROM orders"),
    "subset_averages": (subset_averages, """WITH v AS (SELECT l_suppkey, l_partkey % 5 AS a, CASE WHEN l_partkey % 4 <> 0 THEN max(l_linenumber) END AS v FROM lineitem GROUP BY l_suppkey, l_partkey)
        SELECT l_suppkey, CASE WHEN count(DISTINCT a) = 3 THEN round(avg(v), 6) END AS average FROM v WHERE a IN (1, 3, 4) GROUP BY l_suppkey"""),
    "sequences_per_class": (sequences_per_class, "SELECT event_type, count(*) AS segments, count(DISTINCT user_id) AS sequences FROM events GROUP BY 1"),
    "sequence_centroids": (sequence_centroids, "SELECT user_id, count(*) AS n, median((event_id % 91)::DOUBLE) AS lat, median(value) AS value FROM events GROUP BY 1"),
    "missing_classes": (missing_classes, """WITH o AS (SELECT o_orderpriority, o_custkey AS code FROM orders), t AS (SELECT count(DISTINCT o_orderpriority) AS s FROM o)
        SELECT code, any_value(s) - count(DISTINCT o_orderpriority) AS missing FROM o, t GROUP BY code HAVING count(DISTINCT o_orderpriority) < any_value(s)"""),
    "list_differences": (list_differences, """WITH e AS (SELECT o_custkey, o_orderpriority, 1 AS old, 0 AS new FROM orders UNION ALL SELECT o_custkey + (o_orderkey % 4 = 0)::INT, o_orderpriority, 0, 1 FROM orders),
        a AS (SELECT o_custkey, o_orderpriority, sum(old)::BIGINT AS x, sum(new)::BIGINT AS y FROM e GROUP BY 1, 2)
        SELECT o_custkey, o_orderpriority, CASE WHEN x > y THEN 'removed' ELSE 'added' END AS kind, abs(x - y) AS n FROM a WHERE x <> y"""),
    "first_uploads": (first_uploads, """WITH f AS (SELECT o_custkey % 30 AS dataset, 'u' || (o_custkey % 7) AS u, min(o_orderdate) AS d FROM orders GROUP BY 1, 2) SELECT dataset, string_agg(u, ',' ORDER BY d, u) AS submitters FROM f GROUP BY 1"""),
    "interleaved": (interleaved, """WITH e AS (SELECT event_id AS segment, event_id // 100 AS recording, event_id % 3 = 0 AS labelled FROM events), n AS (SELECT recording, segment AS a, lead(segment) OVER (PARTITION BY recording ORDER BY segment) AS b FROM e WHERE labelled)
        SELECT e.recording, e.segment, n.a AS previous, n.b AS next FROM e JOIN n ON e.recording = n.recording AND e.segment > n.a AND e.segment < n.b WHERE NOT e.labelled AND n.b - n.a <= 5"""),
}
