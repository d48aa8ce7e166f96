"""All queries of the core, by name, with the SQL that states what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import file_queries, hot_hashes, report_queries, score_queries

MODULES = (hot_hashes, file_queries, report_queries, score_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_queries.q_deep_top1(spark, sf_dir)
