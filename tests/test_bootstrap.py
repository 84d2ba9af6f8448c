"""Draws by counting: the same at any partitioning and in plain Python, whole resamples, the shares that were asked for."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.functions import draws
from tarmac.operators import bootstrap


def test_bits_equal_plain_python(spark):
    rows = [(0, 0), (1, -1), (2**31, 5), (-(2**40), 2**62), (7, 2**32 - 1)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", draws.bits(F.col("a"), F.col("b")).alias("x"))
    assert {(r.a, r.b): r.x for r in df.collect()} == {k: draws.python_bits(k) for k in rows}


def test_a_thousand_resamples(spark):
    """Each adds up to the number of groups, each group comes about once a resample, and variances are those of multinomials."""
    groups = spark.createDataFrame([(i * i,) for i in range(40)] + [(4,), (None,)], "g long")
    made = [tuple(r) for r in bootstrap.group_weights(groups, "g", 1000, seed=9).collect()]
    totals, by_group, squares = Counter(), Counter(), 0
    for resample, g, weight in made:
        totals[resample] += weight
        by_group[g] += weight
        squares += (weight - 1) ** 2
    assert set(totals) == set(range(1000)) and set(totals.values()) == {40}
    assert set(by_group) == {i * i for i in range(40)}
    assert all(abs(n / 1000 - 1) < 0.15 for n in by_group.values())
    variance = (squares + 40 * 1000 - len(made)) / 40_000
    assert variance == pytest.approx(1 - 1 / 40, abs=0.03)


def test_partitions_do_not_matter(spark):
    groups = spark.range(30).withColumnRenamed("id", "g")
    sets = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sets.append(sorted(map(tuple, bootstrap.group_weights(groups.repartition(n), "g", 5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sets[0] == sets[1] != sorted(map(tuple, bootstrap.group_weights(groups, "g", 5, seed=1).collect()))


def test_errors(spark):
    groups = spark.range(3).withColumnRenamed("id", "g")
    with pytest.raises(ValueError, match="at least one"):
        bootstrap.group_weights(groups, "g", 0)
    with pytest.raises(ValueError, match="no groups"):
        bootstrap.group_weights(groups.where("false"), "g", 10)
    with pytest.raises(ValueError, match="shared"):
        bootstrap.synthetic_logits(groups, "g", "g", "g", 3, shared=2)


def test_synthetic_errors_are_normal_and_shared(spark):
    rows = spark.range(20_000).select("id", F.floor(F.col("id") / 4).alias("road"), F.lit(None).cast("int").alias("label"))
    made = bootstrap.synthetic_logits(rows, "id", "road", "label", 2, shared=0.4, seed=2).select("id", "road", F.col("logits")[0].alias("x"), F.col("logits")[1].alias("y"))
    one = made.agg(F.avg("x"), F.var_samp("x"), F.corr("x", "y"), F.kurtosis("x")).first()
    assert abs(one[0]) < 0.05 and abs(one[1] - 1) < 0.06 and abs(one[2]) < 0.03 and abs(one[3]) < 0.2
    pairs = made.alias("a").join(made.alias("b"), (F.col("a.road") == F.col("b.road")) & (F.col("a.id") < F.col("b.id")))
    assert pairs.agg(F.corr("a.x", "b.x")).first()[0] == pytest.approx(0.4, abs=0.03)
    shares = bootstrap.synthetic_predictions(rows.withColumn("label", (F.col("id") % 2).cast("int")), "id", "road", "label", 2, strength=1.0)
    # The label wins if the difference of two errors, a normal of variance 2, stays below 1.
    assert shares.agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0] == pytest.approx(0.7602, abs=0.02)
