"""The queue of stale submissions: repeats are dropped, a restart goes on from the checkpoint; counts by windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tarmac.streaming import scoring, stale


def test_stale_submissions_are_scored_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    calls = []

    def upload(*rows):
        spark.createDataFrame(rows, stale.UPLOADS).coalesce(1).write.mode("append").parquet(source)

    def score(batch):
        calls.append(sorted((r.submission, r.version, r.fingerprint) for r in batch.collect()))
        return batch.withColumn("score", F.length("fingerprint"))

    def run():
        stream = spark.readStream.schema(stale.UPLOADS).parquet(source)
        stale.score_due(stream, score, out, checkpoint).awaitTermination()
        found, calls[:] = [c for c in calls if c], []
        return found

    upload(("a", 1, "x"), ("a", 2, "yy"), ("a", 2, "yy"), ("b", 1, "x"), (None, 1, "x"), ("c", 1, None))
    assert run() == [[("a", 2, "yy"), ("b", 1, "x")]]
    assert run() == []
    # A repeat, an older version, and a new one.
    upload(("a", 3, "yy"), ("b", 0, "zzz"), ("d", 7, "w"))
    assert run() == [[("d", 7, "w")]]
    upload(("b", 2, "zzz"))
    assert run() == [[("b", 2, "zzz")]]
    assert {(r.submission, r.score) for r in stale.current_scores(spark, out).collect()} == {("a", 2), ("b", 3), ("d", 1)}


def test_a_failed_batch_runs_again(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([("a", 1, "x")], stale.UPLOADS).write.parquet(source)

    def fail(batch):
        raise RuntimeError("no scores")

    def run(score):
        stale.score_due(spark.readStream.schema(stale.UPLOADS).parquet(source), score, out, checkpoint).awaitTermination()

    try:
        run(fail)
    except Exception as error:
        assert "no scores" in str(error)
    run(lambda batch: batch)
    assert [tuple(r) for r in stale.current_scores(spark, out).collect()] == [("a", 1, "x")]


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), k) for m, k in ((1, "x"), (2, "x"), (8, "y"), (12, "x"), (60, "z"))]
    spark.createDataFrame(rows, "t timestamp, k string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("t timestamp, k string").parquet(source)
    made = scoring.windowed_counts(stream, "t", "10 minutes", "5 minutes", "k")
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r.start.minute, r.k): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(0, "x"): 2, (0, "y"): 1, (10, "x"): 1}
