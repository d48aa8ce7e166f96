"""All queries of this subpackage, by name, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import abuse_queries, match_queries, origin_queries, set_queries, span_queries, token_queries

MODULES = (match_queries, origin_queries, set_queries, span_queries, token_queries, abuse_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
