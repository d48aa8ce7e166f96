"""Problem 2: results per fingerprint hash and truncation flag, a few of which hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.skew import aggregate_skewed, count_distinct_rows, heavy_keys, lookup_join
from tracewright.session import cut, table

CASE_SHARE = 0.005
IDENTITY = ["run_id", "rel_path", "hash_value", "position"]


def run_flags(metadata: DataFrame) -> DataFrame:
    """One row per run with its flag; restated rows of a run hold the same flag or none."""
    return metadata.where("run_id is not null").groupBy("run_id").agg(F.max(F.col("deep_index_truncated").cast("int")).alias("deep_index_truncated"))


def flagged_entries(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = entries.select(*IDENTITY).na.drop()
    return lookup_join(rows, run_flags(metadata), "run_id")


def hash_flag_counts(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """``hash_value, deep_index_truncated, n_rows``: distinct entries per hash and flag of the run, null flags among them."""
    rows = flagged_entries(entries, metadata)
    heavy = heavy_keys(entries.select("hash_value"), "hash_value")
    return count_distinct_rows(rows, ["hash_value", "deep_index_truncated"], IDENTITY, skew_key="hash_value", heavy=heavy)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(hash_flag_counts(table(spark, sf_dir, "fingerprint_entries"), table(spark, sf_dir, "analysis_metadata")))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("deep_index_truncated").isNotNull() & (F.col("n_rows") >= F.lit(CASE_SHARE) * F.lit(total))).select(
        "hash_value", "deep_index_truncated"
    )


def p2_hash_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hash and flag: distinct entries, files that hold it and the range of its positions."""
    rows = flagged_entries(table(spark, sf_dir, "fingerprint_entries"), table(spark, sf_dir, "analysis_metadata"))
    heavy = heavy_keys(rows, "hash_value")
    return aggregate_skewed(
        rows,
        ["hash_value", "deep_index_truncated"],
        partial={
            "n": F.count_distinct("run_id", "rel_path", "position"),
            "files": F.count_distinct("rel_path"),
            "low": F.min("position"),
            "high": F.max("position"),
        },
        final={
            "n_entries": F.sum("n"),
            "n_files": F.sum("files"),
            "first_position": F.min("low"),
            "last_position": F.max("high"),
        },
        spread_by=["rel_path"],
        skew_key="hash_value",
        heavy=heavy,
    )


_COUNTED = """
WITH flags AS (
  SELECT run_id, max(CAST(deep_index_truncated AS INT)) AS deep_index_truncated
  FROM analysis_metadata WHERE run_id IS NOT NULL GROUP BY run_id),
entries AS (
  SELECT DISTINCT run_id, rel_path, hash_value, position FROM fingerprint_entries
  WHERE run_id IS NOT NULL AND rel_path IS NOT NULL AND hash_value IS NOT NULL AND position IS NOT NULL),
flagged AS (SELECT * FROM entries LEFT JOIN flags USING (run_id))
"""

QUERIES = {"p2_found": p2_found, "p2_hash_profile": p2_hash_profile}

SQL = {
    "p2_found": _COUNTED
    + """SELECT hash_value, deep_index_truncated FROM flagged WHERE deep_index_truncated IS NOT NULL
GROUP BY hash_value, deep_index_truncated
HAVING count(*) >= 0.005 * (SELECT count(*) FROM entries)""",
    "p2_hash_profile": _COUNTED
    + """SELECT hash_value, deep_index_truncated, count(*) AS n_entries, count(DISTINCT rel_path) AS n_files,
min(position) AS first_position, max(position) AS last_position
FROM flagged GROUP BY hash_value, deep_index_truncated""",
}
