"""Runs a query and its DuckDB SQL on the same tables and compares their rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or pd.isna(v):
            return None
        if isinstance(v, float) and v == int(v):
            return str(int(v))  # a column of integers with nulls is one of doubles in pandas
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(map(str, (tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))))


def check(spark, query, sql, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
