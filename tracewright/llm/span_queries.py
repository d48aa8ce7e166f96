"""Problem 6: stretches of fingerprint entries that occur verbatim in other files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.spans import shared_spans
from tracewright.session import cut, table

SPAN = 20


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = table(spark, sf_dir, "file_matches").select("rel_path_a")
    return shared_spans(table(spark, sf_dir, "fingerprint_entries"), "rel_path", "position", "hash_value", span=SPAN, only=only)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("record").alias("rel_path"), "start_position", "end_position")


def p6_shared_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file matched as ``rel_path_a``: its entries, how many of them are shared, and the portion."""
    runs = _runs(spark, sf_dir).groupBy(F.col("record").alias("rel_path")).agg(F.sum("n_entries").alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    wanted = table(spark, sf_dir, "file_matches").select(F.col("rel_path_a").alias("rel_path")).where("rel_path is not null").distinct()
    entries = table(spark, sf_dir, "fingerprint_entries").select("rel_path", "position", "hash_value").na.drop()
    sizes = entries.join(wanted, "rel_path", "left_semi").distinct().groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_entries"))
    none = F.lit(0).cast("long")
    return sizes.join(cut(runs), "rel_path", "left").select(
        "rel_path", "n_entries", F.coalesce("n_shared", none).alias("n_shared"), F.coalesce("n_spans", none).alias("n_spans"), (F.coalesce("n_shared", none) / F.col("n_entries")).alias("portion")
    )


_RUNS = """
WITH e AS (
  SELECT DISTINCT rel_path, position, hash_value FROM fingerprint_entries
  WHERE rel_path IS NOT NULL AND position IS NOT NULL AND hash_value IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY position, hash_value) AS i FROM e),
w AS (
  SELECT rel_path, i, list(hash_value) OVER f AS content, count(*) OVER f AS c FROM n
  WINDOW f AS (PARTITION BY rel_path ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
full_w AS (SELECT rel_path, i, CAST(content AS VARCHAR) AS content FROM w WHERE c = 20),
common AS (SELECT content FROM full_w GROUP BY content HAVING count(DISTINCT rel_path) > 1),
starts AS (SELECT rel_path, i FROM full_w SEMI JOIN common USING (content)),
marked AS (
  SELECT n.rel_path, n.position, n.i, s.i AS s, max(s.i) OVER (PARTITION BY n.rel_path ORDER BY n.i) AS latest
  FROM n LEFT JOIN starts s ON s.rel_path = n.rel_path AND s.i = n.i),
shared AS (SELECT rel_path, position, i, i - row_number() OVER (PARTITION BY rel_path ORDER BY i) AS g FROM marked WHERE latest > i - 20),
runs AS (
  SELECT rel_path, min(position) AS start_position, max(position) AS end_position, count(*) AS n_entries FROM shared
  WHERE rel_path IN (SELECT rel_path_a FROM file_matches WHERE rel_path_a IS NOT NULL) GROUP BY rel_path, g)
"""

QUERIES = {"p6_found": p6_found, "p6_shared_portion": p6_shared_portion}

SQL = {
    "p6_found": _RUNS + "SELECT rel_path, start_position, end_position FROM runs",
    "p6_shared_portion": _RUNS
    + """, sizes AS (
  SELECT rel_path, count(*) AS n_entries FROM e WHERE rel_path IN (SELECT rel_path_a FROM file_matches WHERE rel_path_a IS NOT NULL) GROUP BY rel_path),
totals AS (SELECT rel_path, CAST(sum(n_entries) AS BIGINT) AS n_shared, count(*) AS n_spans FROM runs GROUP BY rel_path)
SELECT rel_path, n_entries, coalesce(n_shared, 0) AS n_shared, coalesce(n_spans, 0) AS n_spans,
coalesce(n_shared, 0) / CAST(n_entries AS DOUBLE) AS portion FROM sizes LEFT JOIN totals USING (rel_path)""",
}
