"""Every query of the library gives the rows of its SQL."""

from __future__ import annotations

import pytest
from tests.oracle import check

from tarmac.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_ratio_split(spark):
    """A hash of the key decides, so there is no SQL: about a quarter of the rows, the same ones each time."""
    first, again = (sorted(map(tuple, registry.queries()["ratio_split"](spark, SF).collect())) for _ in range(2))
    assert first == again
    sizes = dict(first)
    assert sum(sizes.values()) == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert 0.1 < sizes[True] / sum(sizes.values()) < 0.4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
