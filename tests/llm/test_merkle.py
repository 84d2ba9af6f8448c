"""The Merkle manifest against a plain recursion."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.llm import merkle, queries

DOC = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root of a list of digests and, for each of them, its siblings as (left, right) by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at // 3 * 3
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        place = [at // 3 for at in place]
    return nodes[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            text = r[4] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None else r[4].replace("\n", "")
            node = leaf_of((*r[:4], text))
            for left, right in path + top:
                node = h(left + node + right)
            out.append((r[0], leaf, subs[s][0], root, h("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, queries.merkle_rows(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Blocks of nine nodes, so that small tables take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)


def rows_of(sizes):
    return [(1000 * k + i, f"s{k}", "en", i, f"line {i}\nend\n" if i % 3 else "one line") for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4, 1), (9, 10, 11, 1), (82, 28, 3, 1, 1, 1, 1, 1, 1, 1, 1)])
def test_sizes_in_small_blocks(spark, small, sizes):
    rows = rows_of(sizes)
    assert got(spark.createDataFrame(rows, DOC)) == expected(rows)


def test_blocks_of_full_size(spark):
    rows = rows_of((700, 244, 1))
    assert got(spark.createDataFrame(rows, DOC)) == expected(rows)


def test_odd_rows(spark, small):
    """Nulls in any column, a null source, empty and long texts, repeated rows, other rows under one id, other columns."""
    rows = [(None, None, None, None, None), (None, "", "en", 0, ""), (1, "", "en", 0, "a\n"), (1, "", "en", 0, "a\n"), (1, "", "de", 0, "b\n"), (2, "é", None, -3, "\n" * 9), (3, "z", "en", 1, "x\n" * 50_000), (4, None, "en", None, "ü\n")]
    df = spark.createDataFrame(rows, DOC).withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x")).withColumn("row", F.lit(2)).withColumn("path", F.lit(3))
    assert got(df) == expected(rows)


def test_repeated_row_in_bulk(spark, small):
    rows = [(7, "s", "en", 1, "same\n")] * 120 + rows_of((5,))
    assert got(spark.createDataFrame(rows, DOC)) == expected(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], DOC)) == []


def test_any_change_is_found(spark, small):
    docs = spark.createDataFrame(rows_of((20, 5)), DOC)
    for column, value in {"text": F.concat("text", F.lit(" ")), "lang": F.lit(None).cast("string"), "n_chars": F.col("n_chars") + 1}.items():
        made = merkle.manifest(docs, altered={column: value})
        assert made.where(merkle.fold(F.col("altered_leaf"), F.col("path")) == F.col("root")).count() == 0
    assert merkle.manifest(docs).where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 25
