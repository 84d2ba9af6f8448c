"""All queries of the library by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.plans import annotation_queries, bootstrap_queries, build_queries, coding_queries, evaluation_queries, label_queries, method_queries, release_queries, report_queries, road_queries, scoring_queries, selection_queries, table_queries, template_queries, track_queries

FLAGSHIP = "attribute_metrics"

_MODULES = (scoring_queries, road_queries, annotation_queries, track_queries, report_queries, method_queries, label_queries, table_queries, bootstrap_queries, evaluation_queries, build_queries, selection_queries, release_queries, coding_queries, template_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query, as a function of a session and the folder of the tables."""
    names = [name for m in _MODULES for name in m.QUERIES]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"two queries of one name: {sorted(twice)}")
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of every query that SQL can express."""
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
