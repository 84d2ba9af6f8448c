"""Queries on tracks and the archive. A track is a user of ``events``; ``orders`` stand for submissions, customers for methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.operators import archive, tracks
from tarmac.plans.scoring_queries import rounded


def _points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400).cast("double")
    p = e.select(F.col("user_id").alias("track_id"), day.alias("t"), (F.lit(16.0) + F.col("value") / 1000).alias("lon"), (F.lit(45.0) + day / 86400).alias("lat"), F.col("event_id"))
    return tracks.last_of_equal_times(p, "track_id", "t", "event_id").drop("event_id")


_PTS = """WITH p AS (SELECT user_id AS track_id, floor(epoch(ts) % 86400)::DOUBLE AS t, 16.0::DOUBLE + value / 1000 AS lon, event_id FROM events),
    pts AS (SELECT track_id, t, lon, 45.0::DOUBLE + t / 86400 AS lat FROM p QUALIFY row_number() OVER (PARTITION BY track_id, t ORDER BY event_id DESC) = 1)"""
_H = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"


def _cuts(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("track_id")).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("cut_no"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for i, (a, b) in enumerate([(100.0, 20000.0), (20000.0, 61234.5)])]))
    return users.select("track_id", each.alias("c")).select("track_id", "c.*")


def web_mercator(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("track_id", "t", F.round(geo.mercator_x(F.col("lon")), 4).alias("x"), F.round(geo.mercator_y(F.col("lat")), 4).alias("y"))


def local_plane(spark, sf_dir):
    p = _points(spark, sf_dir)
    east, north = geo.local_east(F.col("lon"), F.lit(16.0), F.lit(45.0)), geo.local_north(F.col("lat"), F.lit(45.0))
    lat, lon = geo.from_local(east, north, F.lit(45.0), F.lit(16.0))
    return p.select("track_id", "t", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"), (F.abs(lat - F.col("lat")) + F.abs(lon - F.col("lon")) < 1e-9).alias("round_trip"))


def haversine_path(spark, sf_dir):
    return tracks.path(_points(spark, sf_dir), "track_id", "t").select("track_id", "t", F.round("path_m", 3).alias("path_m"))


def bearings(spark, sf_dir):
    return tracks.bearings(_points(spark, sf_dir), "track_id", "t").select("track_id", "t", F.round("bearing", 5).alias("bearing"))


def speeds_ffill(spark, sf_dir):
    return tracks.speeds(_points(spark, sf_dir), "track_id", "t").select("track_id", "t", F.round("speed", 4).alias("speed"))


def sample_by_distance(spark, sf_dir):
    return tracks.every_metres(_points(spark, sf_dir), "track_id", "t", 5000.0).select("track_id", F.col("stretch").cast("long").alias("stretch"), "t")


def cut_interpolate(spark, sf_dir):
    return tracks.cut(_points(spark, sf_dir), _cuts(spark, sf_dir), "track_id", "t", ["lon", "lat"]).select("track_id", "cut_no", F.round("t", 4).alias("t"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def previous_keyframe(spark, sf_dir):
    p = _points(spark, sf_dir)
    return tracks.previous_keyframe(p.select("track_id", "t"), p.where("t % 10 < 1").select("track_id", "t"), "track_id", "t")


def cuts_to_segments(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 500).alias("video"), (F.col("o_orderkey") % 977).cast("double").alias("at"), F.lit(900.0).alias("duration"))
    return tracks.cuts_to_segments(o, "video", "at", "duration")


def _submissions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("submission"), F.col("o_custkey").alias("method"), F.col("o_orderpriority").alias("split"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("uploaded"), "o_orderstatus")


def latest_per_method(spark, sf_dir):
    return archive.latest(_submissions(spark, sf_dir), ["method"], ["uploaded", "submission"]).select("method", "submission", "uploaded")


def anti_stale(spark, sf_dir):
    s = _submissions(spark, sf_dir).select("submission", F.crc32(F.col("split").cast("binary")).alias("fingerprint"))
    done = s.where("submission % 3 = 0").withColumn("fingerprint", F.when(F.col("submission") % 2 == 0, F.col("fingerprint")).otherwise(F.lit(0).cast("long")))
    return archive.stale(s, done, "submission", "fingerprint").select("submission")


def orphan_scorings(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("submission"), "l_linenumber")
    return archive.orphans(li, _submissions(spark, sf_dir).where("o_orderstatus <> 'F'"), "submission").groupBy("submission").agg(F.count(F.lit(1)).alias("n"))


def _methods(spark, sf_dir):
    m = _submissions(spark, sf_dir).groupBy("method").agg(F.avg("score").alias("score"))
    score = F.round(F.col("score") * 100) / 100  # as SQL rounds; round(x, 2) rounds the shortest decimal text of x, and averages often end in half a cent
    return m.withColumn("score", F.when(F.col("method") % 17 != 0, score)).withColumn("metric", F.concat(F.lit("m"), (F.col("method") % 4).cast("string")))


def rank_methods(spark, sf_dir):
    return archive.rank(_methods(spark, sf_dir), F.col("score"), "method", within=["metric"]).select("metric", "method", "rank")


def highlight_strength(spark, sf_dir):
    return rounded(archive.highlight(_methods(spark, sf_dir), "metric", "score", F.col("metric") == "m1").select("metric", "method", "strength"), 4)


def patch_merge(spark, sf_dir):
    s = _submissions(spark, sf_dir).select("submission", "split")
    patch = s.where("submission % 3 = 0").withColumn("split", F.lit("patched"))
    added = s.withColumn("submission", -1 - F.col("submission"))  # the later archive has entries of its own, too
    return archive.later_wins(s, patch.unionByName(added), ["submission"])


def archive_collisions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return archive.collisions(p, F.lower("p_name"), "p_brand")


def method_summary(spark, sf_dir):
    return rounded(archive.method_summary(_submissions(spark, sf_dir), "method", "split", "score", "uploaded"), 2)


def stem_prefix_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("stem"))
    wanted = c.select(F.substring("stem", 1, 17).alias("stem")).distinct().unionByName(c)
    return archive.resolve_stems(c, wanted)


def filter_split(spark, sf_dir):
    s = _submissions(spark, sf_dir)
    return archive.disjoint_parts(s, {"old": F.col("uploaded") < "1994-01-01", "dear": F.col("score") > 200000}).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "web_mercator": (web_mercator, _PTS + " SELECT track_id, t, round(radians(lon) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y FROM pts"),
    "local_plane": (local_plane, _PTS + " SELECT track_id, t, round(radians(lon - 16.0) * cos(radians(45.0)) * 6371008.8, 4) AS east, round(radians(lat - 45.0) * 6371008.8, 4) AS north, true AS round_trip FROM pts"),
    "haversine_path": (haversine_path, _PTS + f", s AS (SELECT *, coalesce({_H.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS m FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t)) SELECT track_id, t, round(sum(m) OVER (PARTITION BY track_id ORDER BY t), 3) AS path_m FROM s"),
    "bearings": (bearings, _PTS + """, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t)),
        b AS (SELECT *, (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360 AS b FROM n)
        SELECT track_id, t, round(last_value(b IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS bearing FROM b"""),
    "speeds_ffill": (speeds_ffill, _PTS + f""", n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(t) OVER w AS t2 FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t)),
        v AS (SELECT *, {_H.format(a='lat', b='lat2', c='lon', d='lon2')} / nullif(t2 - t, 0) AS v FROM n)
        SELECT track_id, t, round(last_value(v IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS speed FROM v"""),
    "sample_by_distance": (sample_by_distance, _PTS + f""", s AS (SELECT *, coalesce({_H.format(a='lag(lat) OVER w', b='lat', c='lag(lon) OVER w', d='lon')}, 0) AS m FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY t)),
        q AS (SELECT track_id, t, floor(sum(m) OVER (PARTITION BY track_id ORDER BY t) / 5000.0)::BIGINT AS stretch FROM s) SELECT track_id, stretch, min(t) AS t FROM q GROUP BY ALL"""),
    "cut_interpolate": (cut_interpolate, _PTS + """, c AS (SELECT DISTINCT track_id, x.cut_no, x.a, x.b FROM pts, (VALUES (0, 100.0::DOUBLE, 20000.0::DOUBLE), (1, 20000.0::DOUBLE, 61234.5::DOUBLE)) x(cut_no, a, b)),
        e AS (SELECT track_id, cut_no, a, unnest([a, b]) AS moment FROM c),
        n AS (SELECT e.*, (SELECT max_by({'t': t, 'lon': lon, 'lat': lat}, t) FROM pts WHERE pts.track_id = e.track_id AND t <= moment) AS p, (SELECT min_by({'t': t, 'lon': lon, 'lat': lat}, t) FROM pts WHERE pts.track_id = e.track_id AND t >= moment) AS q FROM e),
        m AS (SELECT track_id, cut_no, a, moment, coalesce(p, q) AS p, coalesce(q, p) AS q FROM n),
        o AS (SELECT track_id, cut_no, moment - a AS t, p.lon + (q.lon - p.lon) * coalesce((moment - p.t) / nullif(q.t - p.t, 0), 0) AS lon, p.lat + (q.lat - p.lat) * coalesce((moment - p.t) / nullif(q.t - p.t, 0), 0) AS lat FROM m
              UNION SELECT track_id, cut_no, t - a, lon, lat FROM pts JOIN c USING (track_id) WHERE t > a AND t < b)
        SELECT track_id, cut_no, round(t, 4) AS t, round(lon, 6) AS lon, round(lat, 6) AS lat FROM o"""),
    "previous_keyframe": (previous_keyframe, _PTS + """, k AS (SELECT track_id, t, t AS k FROM pts WHERE t % 10 < 1), f AS (SELECT track_id, min(k) AS k0 FROM k GROUP BY 1)
        SELECT p.track_id, p.t, coalesce(k.k, f.k0) AS keyframe FROM pts p ASOF LEFT JOIN k ON p.track_id = k.track_id AND p.t >= k.t LEFT JOIN f ON f.track_id = p.track_id"""),
    "cuts_to_segments": (cuts_to_segments, """WITH o AS (SELECT DISTINCT o_custkey % 500 AS video, (o_orderkey % 977)::DOUBLE AS c FROM orders), s AS (SELECT video, c FROM o WHERE c > 0 AND c < 900 UNION SELECT video, 0.0::DOUBLE FROM o)
        SELECT video, (row_number() OVER w - 1)::INT AS cut_no, c AS start_s, lead(c, 1, 900.0::DOUBLE) OVER w AS end_s FROM s WINDOW w AS (PARTITION BY video ORDER BY c)"""),
    "latest_per_method": (latest_per_method, "SELECT o_custkey AS method, o_orderkey AS submission, o_orderdate AS uploaded FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "anti_stale": (anti_stale, "SELECT o_orderkey AS submission FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)"),
    "orphan_scorings": (orphan_scorings, "SELECT l_orderkey AS submission, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey"),
    "rank_methods": (rank_methods, "WITH m AS (SELECT o_custkey AS method, 'm' || (o_custkey % 4) AS metric, CASE WHEN o_custkey % 17 <> 0 THEN round(avg(o_totalprice), 2) END AS score FROM orders GROUP BY o_custkey) SELECT metric, method, row_number() OVER (PARTITION BY metric ORDER BY score IS NULL, score DESC, method)::INT AS rank FROM m"),
    "highlight_strength": (highlight_strength, """WITH m AS (SELECT o_custkey AS method, 'm' || (o_custkey % 4) AS metric, CASE WHEN o_custkey % 17 <> 0 THEN round(avg(o_totalprice), 2) END AS score FROM orders GROUP BY o_custkey),
        r AS (SELECT *, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS s FROM m WINDOW w AS (PARTITION BY metric)) SELECT metric, method, round(CASE WHEN metric = 'm1' THEN 1 - s ELSE s END, 4) AS strength FROM r"""),
    "patch_merge": (patch_merge, "SELECT o_orderkey AS submission, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderpriority END AS split FROM orders UNION ALL SELECT -1 - o_orderkey, o_orderpriority FROM orders"),
    "archive_collisions": (archive_collisions, "SELECT lower(p_name) AS key, count(*) AS n, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'identical' ELSE 'differing' END AS kind FROM part GROUP BY 1 HAVING count(*) > 1"),
    "method_summary": (method_summary, "SELECT o_custkey AS method, count(*) AS models, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS splits, round(sum(o_totalprice), 2) AS size, min(o_orderdate) AS first_upload, max(o_orderdate) AS last_upload FROM orders GROUP BY o_custkey"),
    "stem_prefix_join": (stem_prefix_join, """WITH w AS (SELECT DISTINCT left(c_name, 17) AS wanted FROM customer UNION SELECT c_name FROM customer),
        h AS (SELECT wanted, max(c_name) FILTER (c_name = wanted) AS exact, count(DISTINCT c_name) AS found, min(c_name) AS single FROM w JOIN customer ON starts_with(c_name, wanted) GROUP BY wanted)
        SELECT wanted, coalesce(exact, CASE WHEN found = 1 THEN single END) AS resolved, found FROM h"""),
    "filter_split": (filter_split, "SELECT CASE WHEN o_orderdate < '1994-01-01' THEN 'old' WHEN o_totalprice > 200000 THEN 'dear' ELSE 'rest' END AS part, count(*) AS n FROM orders GROUP BY 1"),
}
