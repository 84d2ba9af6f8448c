"""Token counts by vocabularies against the tokenizers library, and rollups of their revisions."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import queries, token_counts
from tests.oracle import check

SF = "/root/testdata/sf0.001"

#: Rollup of the versions that need no vocabulary, after the same batches.
SQL = r"""
        WITH c AS (SELECT source, lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS poor,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS s,
                          len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]')) AS m
                   FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
        SELECT source, lang, CASE WHEN poor THEN 'mark-1' ELSE 'space-1' END AS version, count(*) AS docs,
               sum(CASE WHEN poor THEN m ELSE s END)::BIGINT AS tokens
        FROM c GROUP BY ALL"""


def library(path):
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    tool.encode_special_tokens = "byte" in path  # op6's contract takes the strings of special tokens as such
    return tool


def test_bytes_equal_the_library():
    path = queries.vocabularies()["bytes-50k"]
    tool, own = library(path), token_counts.tokenizer(path)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng = np.random.RandomState(11)
    texts = ["", " ", "\n\n a", "a  b   c\t\td \n", "It's I'LL we've 'S <|endoftext|>x", "日本語👍🏽 e\u0301", "1234567 12 x1y", "a" * 3000, "ab" * 2000, " " * 2500, "\x1c\x1d\x1e\x1f\x85\u2028 x"]
    texts += ["".join(f"a{chr(c)}b !{chr(c)}! 1{chr(c)} " for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    texts += ["".join(map(chr, rng.choice(points[:0x2500], 20))) for _ in range(2000)]
    texts += ["".join(rng.choice(list("ab cd\n '"), 60)) for _ in range(500)]
    for text, ids, theirs in zip(texts, own.encode_batch(texts), tool.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == theirs.ids, text[:40]
        assert own.decode(ids) == text


def test_query_equals_counts_of_the_library(spark):
    tools = {v: library(p) for v, p in queries.vocabularies().items()}
    marks = defaultdict(lambda: [False, False])
    for d, quality, toxic in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall():
        marks[d] = [marks[d][0] or quality == 0, marks[d][1] or toxic == 1]
    want = defaultdict(lambda: [0, 0])
    for d, text, source, lang in duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet'").fetchall():
        poor, toxic = marks[d]
        if not toxic:
            version = "bytes-50k" if poor else "words-49k"
            total = want[source, lang, version]
            total[0] += 1
            total[1] += len(tools[version].encode(text or "", add_special_tokens=False).ids)
    made = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in queries.op9_token_counts(spark, SF).collect()}
    assert made == dict(want) and {v for *_, v in made} == set(tools)


def test_versions_without_a_vocabulary_equal_their_sql(spark):
    def rollup(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        counts = docs.select("doc_id", "source", "lang", *[token_counts.count_tokens(F.col("text"), v).alias(v) for v in token_counts.VERSIONS])
        return queries.rolled_up(spark, counts, spark.read.parquet(f"{sf_dir}/labels.parquet"), *token_counts.VERSIONS)

    check(spark, rollup, SQL, SF)


def test_counts_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, no rows, and columns with the versions' names."""
    rows = [(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "word " * 40_000), (None, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words-49k", F.lit("clash")).withColumn("row", F.lit(1))
    made = sorted(((r.row.doc_id or 0, r["words-49k"], r["bytes-50k"]) for r in token_counts.vocabulary_counts(docs, queries.vocabularies()).collect()))
    assert [m[:2] for m in made] == [(0, 0), (0, 0), (1, 0), (2, 2), (2, 2), (3, 40_000)] and made[5][2] == 40_001
    assert token_counts.vocabulary_counts(docs.limit(0), queries.vocabularies()).count() == 0
