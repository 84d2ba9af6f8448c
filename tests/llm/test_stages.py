"""Every stage of the pipeline on odd rows: nulls, repeats, no rows, and columns whose names or types could be in the way."""

from __future__ import annotations

import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tarmac.llm.common import written

SF = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, lang string, source string, n_chars long, _id long, _tk string, _gone boolean, ids string, input_ids int, N_Tokens double, row struct<a:int>, label map<string,array<int>>, tk int, score string, `a.b` int"
TEXT = "Das ist ein langer deutscher Satz, der in keiner anderen Zeile steht. " * 3


def odd(spark):
    def row(i, text, k=0):
        return (i, text, None, None, 7, k, "x", None, "ids", 3, 0.5, (k,), {"b": [1, None], "a": None}, 5, "s", 9)

    rows = [row(1, TEXT), row(1, TEXT), row(2, TEXT, 4), row(None, TEXT), row(None, None), row(3, None), row(3, None), row(4, ""), row(5, " \n\t "), row(6, "12 34"), row(7, "wort " * 20_000), (*[None] * 16,)]
    return spark.createDataFrame(rows, ROW)


def plain(df):
    return Counter(str(r.asDict(recursive=True)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark)


def test_language(spark, docs):
    kept = p.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert plain(kept) <= plain(docs)
    assert kept.where("text is null or doc_id in (4, 5, 6)").count() == 0


def test_near_duplicates(spark, docs):
    kept = p.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    whole = plain(kept)
    assert whole <= plain(docs)
    # Of the five rows of one text, one of id 1 is left; rows without words all stay.
    assert kept.where(F.col("text") == TEXT).select("doc_id", "_id").collect() == [(1, 0)]
    assert sum(whole.values()) == docs.count() - 3


def test_repeated_passages(spark, docs):
    kept = p.repeated_passages(spark, docs, SF)
    assert kept.columns == docs.columns
    same = kept.where("doc_id is null or doc_id > 2")
    assert same.where("text is null").count() == docs.where("text is null").count()
    assert plain(kept.where("doc_id in (3, 4, 5, 6)")) == plain(docs.where("doc_id in (3, 4, 5, 6)"))
    bare = p.repeated_passages(spark, docs.drop("n_chars"), SF)
    assert "n_chars" not in bare.columns and bare.count() == kept.count()


def on_disk(spark):
    """Shuffle files that Spark holds, and scratch tables in the shared folder."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = {f for d in manager.localDirsString() for f in Path(str(d)).rglob("shuffle_*.data")}
    return shuffles, set(Path(spark.conf.get("spark.checkpoint.dir")).glob("tarmac-*"))


def gone(spark, held):
    """Whether Spark holds no other shuffle files than before; it deletes them beside the query."""
    for _ in range(50):
        if not on_disk(spark)[0] - held:
            return True
        time.sleep(0.1)
    return False


def test_written_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for before in (None, "false", "true"):
        if before:
            spark.conf.set(key, before)
        held, _ = on_disk(spark)
        counts = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert gone(spark, held) and counts.count() == 7 and spark.conf.get(key, None) == before
    spark.conf.unset(key)


def test_repeated_passages_hold_no_shuffles_of_runs(spark, docs):
    held, tables = on_disk(spark)
    kept = p.repeated_passages(spark, docs, SF)
    assert gone(spark, held) and len(on_disk(spark)[1] - tables) == 1
    # What is left to do is one join of texts and places by document.
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1 and "collect_set" not in plan


def test_benchmark_leaks(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).withColumn("text", F.lit("before " + item + " after"))
    kept = p.benchmark_leaks(spark, docs.unionByName(leak), SF)
    assert kept.columns == docs.columns and plain(kept) == plain(docs)


def test_tokens(spark, docs):
    made = p.tokens(spark, docs, SF)
    assert [c for c in made.columns if "ids" in c] == ["input_input_ids", "input_ids", "ids_sha256", "ids"]
    assert len({c.lower() for c in made.columns}) == len(made.columns) == len(docs.columns) + 4
    assert made.where("text is null and (n_tokens <> 0 or size(ids) <> 0)").count() == 0
    assert made.count() == docs.count() and made.where("n_tokens <> size(ids)").count() == 0
    assert {r[0] for r in made.where("doc_id = 2").select("input_N_Tokens").collect()} == {0.5}


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_no_rows(spark, docs, name):
    stage = dict(p.STAGES)[name]
    made = stage(spark, docs.where("false"), SF)
    assert made.count() == 0 and set(docs.columns) - {"ids", "N_Tokens"} <= set(made.columns)
