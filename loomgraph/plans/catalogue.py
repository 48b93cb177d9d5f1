"""All queries of the library by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import graph_queries, record_queries, series_queries, stat_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list = [series_queries, graph_queries, text_queries, stat_queries, record_queries]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
