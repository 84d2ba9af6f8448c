"""Scores of the n-gram model against plain counts, and the sequences it is kept in."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.llm import lm_score, queries
from tarmac.llm.elias_fano import EliasFano, TrieLevel

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def expected(rows, order):
    rows = [(d, d is None or zlib.crc32(str(d).encode()) % 10 == 0, tokens(t)) for d, t in rows]
    grams, contexts = Counter(), Counter()
    for _, held, t in rows:
        padded = ["^"] * (order - 1) + t
        for i in range(len(t)) if not held else ():
            for n in range(1, order + 1):
                g = tuple(padded[i + order - n : i + order])
                grams[g] += 1
                contexts[g[:-1]] += 1
    total, words = contexts[()], sum(len(g) == 1 for g in grams)

    def chance(g):
        if len(g) == 1:
            return (grams[g] + 0.1) / (total + 0.1 * (words + 1))
        return (grams[g] + lm_score.LOWER * chance(g[1:])) / (contexts[g[:-1]] + lm_score.LOWER)

    out = []
    for d, held, t in rows:
        padded = ["^"] * (order - 1) + t
        score = sum(math.log10(chance(tuple(padded[i : i + order]))) for i in range(len(t)))
        out.append((d, held, len(t), sum(grams[(w,)] > 0 for w in t), total, sum(math.log10(chance((w,))) for w in t), score))
    return sorted(out, key=str)


def close(ours, theirs):
    ours = sorted(ours, key=str)
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]
    for a, b in zip(ours, theirs, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert abs(a[6] - b[6]) <= 1e-6 + a[2] * 1.05 * lm_score.STEP


def got(df, order=lm_score.ORDER):
    out = lm_score.score_texts(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order=order)
    return [tuple(r) for r in out.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_brute_force(spark, monkeypatch, order):
    """Several batches and shards; contexts of more than three occurrences are dealt out."""
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 3000)
    monkeypatch.setattr(lm_score, "HOT", 3)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:120]
    rows = [(d, " ".join(t.split()[:150])) for d, t in rows]
    close(got(spark.createDataFrame(rows, DOC), order), expected(rows, order))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    close([tuple(r) for r in queries.op13_lm_score(spark, SF).collect()], expected(rows, lm_score.ORDER))


def test_odd_rows(spark):
    """Null ids and texts, blank and repeated texts, a long one, a hot word, clashing columns."""
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "A b\vc"), (4, "A b\vc"), (5, "x " * 60_000), (6, "é \x00 b"), (7, "b"), (17, "unknown words"), (None, None)]
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d)
    df = spark.createDataFrame(rows, DOC).withColumn("row", F.lit(1)).withColumn("docs", F.lit(2)).withColumn("b", F.lit(3)).withColumn("score", F.lit("s")).withColumn("held_out", F.lit(None).cast("boolean"))
    close(got(df), expected(rows, 2))
    close(got(df, 3), expected(rows, 3))


def test_no_rows_and_no_training(spark):
    assert got(spark.createDataFrame([], DOC)) == []
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    assert got(spark.createDataFrame([(held, "a b c")], DOC)) == [(held, True, 4, 0, 0, 0.0, 0.0)]


def test_chances_add_up(spark):
    """All words of the vocabulary and one never seen, after the same beginning: their chances add up to one."""
    train = [(1, "a b a c"), (2, "a a b"), (3, "c a")]
    held = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    assert not any(d in held for d, _ in train)
    asked = [(held[0], "a a"), (held[1], "a b"), (held[2], "a c"), (held[3], "a never")]
    scores = {r[0]: r for r in got(spark.createDataFrame(train + asked, DOC))}
    ends = {w: 10 ** (r[6] - e) for w, (d, _), e in zip("abcn", asked, _ends(train), strict=True) for r in [scores[d]]}
    first, end_after_a = _chance(train, "^", "a"), _chance(train, "a", None)
    assert sum(ends.values()) / first + end_after_a == pytest.approx(1, abs=5e-3)


def _chance(train, context, word):
    flat = [("^", *tokens(t)) for _, t in train]
    words = Counter(w for t in flat for w in t[1:])
    pairs, of = Counter(p for t in flat for p in zip(t, t[1:], strict=False)), Counter(c for t in flat for c in t[:-1])
    single = (words[word] + 0.1) / (sum(words.values()) + 0.1 * (len(words) + 1))
    return (pairs[context, word] + lm_score.LOWER * single) / (of[context] + lm_score.LOWER)


def _ends(train):
    return [math.log10(_chance(train, w, None)) for w in ("a", "b", "c", "never")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), max_size=20), st.integers(0, 61))
def test_elias_fano(values, others, shift):
    values = np.sort(np.array([v >> shift for v in values], np.uint64))
    s = EliasFano(EliasFano.parts(values))
    assert (s.get(np.arange(len(values))) == values).all()
    asked = np.concatenate((values, np.array([v >> shift for v in others], np.uint64), values + np.uint64(1)))
    assert (s.find(asked) == np.searchsorted(values, asked)).all()


def test_trie_level_is_compact_and_whole():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.zipf(1.3, (60_000, 2)) % 5000, axis=0)
    codes, counts = rng.integers(0, 60000, len(keys)).astype(np.uint16), np.arange(len(keys))
    trie = TrieLevel(keys[:, 0], keys[:, 1], codes, counts)
    assert (trie.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    other = rng.integers(0, 6000, (5000, 2))
    held = set(map(tuple, keys.tolist()))
    assert ((trie.find(other[:, 0], other[:, 1]) >= 0) == [tuple(x) in held for x in other.tolist()]).all()
    # Without codes and counts, well below the 16 bytes of two plain integers.
    assert (trie.mapped.bytes - codes.nbytes - counts.nbytes) / len(keys) < 5
    assert (TrieLevel(*[np.zeros(0, np.int64)] * 4).find(np.array([1]), np.array([2])) == -1).all()
