"""Hard negatives against plain sums over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import hard_negatives
from tarmac.llm.hard_negatives import candidates, feasible

VECTOR = "vec_id long, embedding array<float>, label int"


def expected(rows, step=50, positives=5, negatives=3):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    rows = sorted({i: (i, v, y) for i, v, y in rows}.values())
    out = []
    for a, v, y in rows:
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, z) for i, w, z in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


def got(df, step=50, **options):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % step == 0, **options).collect()))


def table(rng, n, d, labels, spread=1.0, lengths=False):
    x = rng.normal(size=(n, d)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    if lengths:
        x *= np.exp(rng.normal(size=(n, 1)))
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("lengths", [False, True])
def test_brute_force(spark, monkeypatch, lengths):
    """Several buckets, groups and blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 64)
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8000)
    rows = table(np.random.default_rng(3), 600, 8, 4, lengths=lengths)
    assert got(spark.createDataFrame(rows, VECTOR), step=10) == expected(rows, 10)


def test_ties_and_one_common_vector(spark):
    """A third of all rows has one vector, so ids decide; some anchors have few partners."""
    rng = np.random.default_rng(5)
    rows = table(rng, 400, 4, 3)
    rows = [(i, [0.5, 0.5, -0.5, 0.5] if i % 3 == 0 else v, 9 if i == 50 else y) for i, v, y in rows]
    assert got(spark.createDataFrame(rows, VECTOR)) == expected(rows)


def test_odd_rows(spark):
    """Nulls, values that are not finite, empty and short vectors, repeated rows, vectors too long to be scored."""
    rows = table(np.random.default_rng(7), 120, 6, 2)
    bad = [(None, [1.0] * 6, 1), (200, None, 1), (201, [1.0] * 6, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (203, [float("nan")] * 6, 0), (204, [float("inf")] * 6, 1), (205, [], 1), (250, [], 0), (206, [0.5, 0.5], 1), (300, [0.0] * 6, 1), rows[3]]
    huge = [(400, [3e30] * 6, 1)]
    df = spark.createDataFrame(rows + bad + huge, VECTOR).withColumn("id", F.lit(1)).withColumn("x", F.lit("a")).withColumn("anchor", F.lit(None).cast("boolean"))
    assert got(df) == expected(rows + bad)


def test_large_components(spark):
    """Sums beyond 2**53 are exact."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * 1e6], int(i % 2)) for i in range(150)]
    assert got(spark.createDataFrame(rows, VECTOR)) == expected(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], VECTOR)) == []
    assert got(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], VECTOR)) == []


def test_ranges_lose_no_partner():
    """Rows that reach the floor are candidates; on vectors near the axes most others are not."""
    rng = np.random.default_rng(13)
    axes = np.eye(16)[rng.integers(16, size=900)] * rng.choice([-1, 1], (900, 1)) + rng.normal(size=(900, 16)) * 0.05
    length = np.linalg.norm(axes, axis=1)
    unit = axes / length[:, None]
    floor = np.full(40, 0.8)
    found = candidates(unit, length.max(), unit[:40], length[:40], floor)
    assert found[(axes[:40] @ axes.T) >= 0.8].all()
    assert found.mean() < 0.1
    assert not candidates(unit, length.max(), unit[:2], length[:2], np.full(2, 9.0)).any()
    assert candidates(unit, length.max(), unit[:2], length[:2], np.full(2, -1.0)).all()
    low, high = feasible(np.array([1.0, 0.0]), np.array([0.5, 1.0]))
    assert np.allclose(low, [0.5, 0.0]) and np.allclose(high, [1.0, 0.0])
