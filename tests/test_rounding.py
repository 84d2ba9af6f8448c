"""Roundings of ties are those of the SQL."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.oracle import rows

from tarmac.functions import text
from tarmac.plans import registry


def _agrees(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    assert rows(registry.queries()[name](spark, str(folder)).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def _orders(folder, keys, customers, prices):
    n = len(keys)
    dates = pa.array([0] * n, pa.timestamp("us"))
    table = {"o_orderkey": keys, "o_custkey": customers, "o_orderstatus": ["O"] * n, "o_totalprice": prices, "o_orderdate": dates, "o_orderpriority": ["1-URGENT"] * n}
    pq.write_table(pa.table(table), f"{folder}/orders.parquet")


def test_averages_that_end_in_half_a_cent(spark, tmp_path):
    """Averages of two prices a cent apart; each method has a rival of the cent above and one of the cent below."""
    cents = [10_001 + 7 * i for i in range(400)]
    prices, customers = [], []
    for i, c in enumerate(cents):
        for price in ((c / 100, (c + 1) / 100), (c / 100,) * 2, ((c + 1) / 100,) * 2):
            customers += [4 * (len(customers) // 2)] * 2
            prices += price
    _orders(tmp_path, list(range(len(prices))), customers, prices)
    _agrees(spark, "rank_methods", tmp_path)


@pytest.mark.parametrize("divisor", [97.0, 9973.0])
def test_ratios_at_ties(spark, tmp_path, divisor):
    keys = [2 * i + (divisor > 100) for i in range(400)]
    _orders(tmp_path, keys, keys, [round(divisor * i / 20, 2) for i in range(400)])
    _agrees(spark, "share_texts", tmp_path)


def test_fixed_texts(spark):
    values = [0.25, 0.35, 0.75, -0.25, 12345.65, -0.04]
    shown = spark.createDataFrame([(v,) for v in values], "x double").select(text.fixed_text(F.col("x"), 1), text.metric_text(F.col("x"), 1)).collect()
    assert [r[0] for r in shown] == [f"{v:.1f}" for v in values]
    assert [r[1] for r in shown] == [".2", ".3", ".8", "-.2", "12345.6", "-.0"]
