"""A training corpus from raw documents: language, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, decontaminate, jaccard_join, langid, substring_dedup
from tarmac.llm.common import written
from tarmac.llm.queries import tokenizer_path

#: A document whose most probable language has less of the posterior than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no language that is more probable than not."""
    model = langid.fit(docs.where(~langid.held_out()))
    done = langid.predict(docs, model, keep=tuple(docs.columns))
    return done.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the smallest id (null last), text key and other columns.

    Rows are told apart by id and text, so copies under one id or without an id go too, and another text under the id of
    a copy stays. Of rows equal in both, the first by the JSON of their other columns stays, whatever types these have.
    Rows without shingles (null and blank texts) stand alone and stay. No name of a column matters but doc_id and text.
    """
    rows = written(jaccard_join.labelled_rows(docs).where("label is not null").groupBy("id", "tk", "label").agg(F.count(F.lit(1)).alias("copies")))
    key = F.struct(F.col("id").isNull().alias("unnamed"), "id", "tk")
    least = rows.groupBy(F.col("label").alias("l2")).agg(F.min(key).alias("least"))
    marked = rows.join(least, F.col("label") == F.col("l2")).withColumn("gone", ~key.eqNullSafe(F.col("least")))
    marks = marked.where("gone or copies > 1").select(F.col("id").alias("mark_id"), F.col("tk").alias("mark_tk"), "gone")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), F.struct(*others).alias("others"))
    # Most rows have no mark and pass; of rows equal in id and text, one is found by partial aggregates.
    told = packed.join(marks, (F.col("tk") == F.col("mark_tk")) & F.col("id").eqNullSafe(F.col("mark_id")), "left")
    equal = told.where("not gone").groupBy("mark_id", "mark_tk").agg(F.min_by("row", F.to_json("others")).alias("row"))
    return told.where("gone is null").select("row.*").unionByName(equal.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated runs of sentences out of all but their first document; documents of which nothing is left go.

    Null and blank texts have no sentences and stay. Where a text changes, n_chars, if there is such a column, follows it.
    """
    done = substring_dedup.remove_repeats(docs, keep=tuple(docs.columns))
    kept = done.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    changed = F.col("n_removed") > 0
    values = {"text": F.col("text"), "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return kept.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts hold none and stay."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where("n_hit = 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised corpus: all columns, and the ids of every whole text, with digests of the ids and of the decoded text.

    A null text has no ids. A column that has the name of a new one, in any case, gets ``input_`` before it.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    done = bpe.round_trip(docs, tokenizer_path(), keep=tuple(docs.columns), with_ids=True)
    taken = {*new, *(c.lower() for c in docs.columns)}
    kept = []
    for c in docs.columns:
        name = c
        while name.lower() in new or name != c and name.lower() in taken:
            name = f"input_{name}"
        taken.add(name.lower())
        kept.append(F.col(f"row.`{c}`").alias(name))
    return done.select(*kept, *new)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: No SQL: naive Bayes, components and BPE merges are iterative; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; each one's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
