"""Queries on road sequences. A road is a user of ``events``, its segments are the events by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import roads


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("segment_id"), F.col("user_id").alias("road_id"), "ts", "event_type", "value")
    return roads.positions(e, "road_id", ["ts", "segment_id"])


_E = """WITH e AS (SELECT event_id AS segment_id, user_id AS road_id, ts, event_type, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS seq_len FROM events)"""


def road_positions(spark, sf_dir):
    return _events(spark, sf_dir).select("segment_id", "road_id", "position", "seq_len")


def _two_roads(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("segment_id"), "user_id", "event_type", "ts")
    both = e.select("segment_id", F.explode(F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("t"), F.col("event_type"), F.lit("-"), (F.col("user_id") % 50).cast("string")))).alias("road_id"), "ts")
    return roads.positions(both, "road_id", ["ts", "segment_id"])


_TWO = """WITH b AS (SELECT event_id AS segment_id, unnest(['u' || user_id, 't' || event_type || '-' || (user_id % 50)]) AS road_id, ts FROM events),
    r AS (SELECT segment_id, road_id, row_number() OVER (PARTITION BY road_id ORDER BY ts, segment_id) - 1 AS position, count(*) OVER (PARTITION BY road_id) AS seq_len FROM b)"""


def longest_road_index(spark, sf_dir):
    return roads.longest_road(_two_roads(spark, sf_dir))


def shared_segments(spark, sf_dir):
    return roads.shared_segments(_two_roads(spark, sf_dir))


OFFSETS = (-2, -1, 0, 3)


def context_windows(spark, sf_dir):
    e = roads.complete_context(_events(spark, sf_dir), "road_id", "position", "segment_id", OFFSETS, F.col("event_type") != "error")
    return e.select("segment_id", F.array_join(F.transform("context", lambda c: c.cast("string")), ",").alias("context"))


def display_context(spark, sf_dir):
    e = roads.context(_events(spark, sf_dir), "road_id", "position", "segment_id", (-1, 1))
    return e.select("segment_id", F.col("context")[0].alias("before"), F.col("context")[1].alias("after"))


def ncontext_filter(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("split", F.col("position") % 40 < 30)
    return roads.neighbours_agree(e, "road_id", "position", "split", 5).select("segment_id", "split")


def split_into_runs(spark, sf_dir):
    return roads.runs(_events(spark, sf_dir), "road_id", "segment_id", 150).groupBy("road_id", "run").agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi"), F.count(F.lit(1)).alias("n"))


def adjacency_parts(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("start", F.col("position") * 20.0 + F.when(F.col("value") > 40, F.col("position") * 0.5).otherwise(0.0)).withColumn("length", F.lit(20.0))
    return roads.parts(e, "road_id", "start", "length", 2.5).select("segment_id", "part")


def row_ranges(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return roads.id_ranges(o.select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("id")), "grp", "id")


def interpolate_coordinates(spark, sf_dir):
    at = F.col("position") % 7 == 3
    e = _events(spark, sf_dir).withColumn("lon", F.when(at, 16 + F.col("value") / 100)).withColumn("lat", F.when(at, 45 + F.col("position") * 0.001))
    return roads.interpolate(e, "road_id", "position", ["lon", "lat"]).select("segment_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def next_with_data(spark, sf_dir):
    return roads.next_with(_events(spark, sf_dir), "road_id", "position", "segment_id", F.col("event_type") == "purchase").select("segment_id", "next_id")


def sequence_numbers(spark, sf_dir):
    return roads.dense_numbers(_events(spark, sf_dir), "road_id", ["ts", "segment_id"])


QUERIES = {
    "road_positions": (road_positions, _E + " SELECT segment_id, road_id, position::INT AS position, seq_len FROM e"),
    "longest_road_index": (longest_road_index, _TWO + " SELECT segment_id, road_id, position::INT AS position, seq_len FROM r QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY seq_len DESC, road_id, position) = 1"),
    "shared_segments": (shared_segments, _TWO + " SELECT segment_id, count(DISTINCT road_id) AS roads, string_agg(DISTINCT road_id, ',' ORDER BY road_id) AS road_ids FROM r GROUP BY segment_id HAVING count(DISTINCT road_id) > 1"),
    "context_windows": (context_windows, _E + """, f AS (SELECT *, CASE WHEN event_type <> 'error' THEN segment_id END AS ok FROM e),
        g AS (SELECT segment_id, lag(ok, 2) OVER w AS a, lag(ok, 1) OVER w AS b, ok AS c, lead(ok, 3) OVER w AS d FROM f WINDOW w AS (PARTITION BY road_id ORDER BY position))
        SELECT segment_id, a || ',' || b || ',' || c || ',' || d AS context FROM g WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL"""),
    "display_context": (display_context, _E + " SELECT segment_id, lag(segment_id) OVER w AS before, lead(segment_id) OVER w AS after FROM e WINDOW w AS (PARTITION BY road_id ORDER BY position)"),
    "ncontext_filter": (ncontext_filter, _E + """, s AS (SELECT *, position % 40 < 30 AS split FROM e)
        SELECT segment_id, split FROM s WINDOW w AS (PARTITION BY road_id ORDER BY position ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) QUALIFY count(*) OVER w = 11 AND min(split) OVER w = max(split) OVER w"""),
    "split_into_runs": (split_into_runs, _E + """, n AS (SELECT *, CASE WHEN segment_id - lag(segment_id) OVER (PARTITION BY road_id ORDER BY segment_id) > 150 THEN 1 ELSE 0 END AS new FROM e),
        r AS (SELECT *, sum(new) OVER (PARTITION BY road_id ORDER BY segment_id) AS run FROM n) SELECT road_id, run::BIGINT AS run, min(segment_id) AS lo, max(segment_id) AS hi, count(*) AS n FROM r GROUP BY road_id, run"""),
    "adjacency_parts": (adjacency_parts, _E + """, s AS (SELECT *, position * 20.0::DOUBLE + CASE WHEN value > 40 THEN position * 0.5::DOUBLE ELSE 0 END AS start FROM e),
        n AS (SELECT *, CASE WHEN abs(start - (lag(start) OVER w + 20.0)) > 2.5 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY road_id ORDER BY start))
        SELECT segment_id, sum(new) OVER (PARTITION BY road_id ORDER BY start)::BIGINT AS part FROM n"""),
    "row_ranges": (row_ranges, """WITH i AS (SELECT DISTINCT o_custkey % 50 AS grp, o_orderkey AS id FROM orders), n AS (SELECT *, id - row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM i),
        r AS (SELECT grp, min(id) AS lo, max(id) AS hi FROM n GROUP BY grp, k) SELECT grp, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY grp"""),
    "interpolate_coordinates": (interpolate_coordinates, _E + """, k AS (SELECT *, CASE WHEN position % 7 = 3 THEN 16 + value / 100 END AS lon, CASE WHEN position % 7 = 3 THEN 45 + position * 0.001::DOUBLE END AS lat, CASE WHEN position % 7 = 3 THEN position END AS kp FROM e),
        j AS (SELECT segment_id, position, last_value(kp IGNORE NULLS) OVER b AS ao, last_value(lon IGNORE NULLS) OVER b AS alon, last_value(lat IGNORE NULLS) OVER b AS alat,
              first_value(kp IGNORE NULLS) OVER f AS bo, first_value(lon IGNORE NULLS) OVER f AS blon, first_value(lat IGNORE NULLS) OVER f AS blat FROM k
              WINDOW b AS (PARTITION BY road_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY road_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT segment_id, round(alon + (blon - alon) * coalesce((position - ao) / nullif(bo - ao, 0), 0), 6) AS lon, round(alat + (blat - alat) * coalesce((position - ao) / nullif(bo - ao, 0), 0), 6) AS lat FROM j"""),
    "next_with_data": (next_with_data, _E + " SELECT segment_id, first_value(CASE WHEN event_type = 'purchase' THEN segment_id END IGNORE NULLS) OVER (PARTITION BY road_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM e"),
    "sequence_numbers": (sequence_numbers, "SELECT user_id AS road_id, (row_number() OVER (ORDER BY min({'ts': ts, 'id': event_id})) - 1)::INT AS number FROM events GROUP BY user_id"),
}
