"""Problems 1 and 4: groups of linked files, and the best matches of each file, from deep match results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.components import connected_groups
from tracewright.llm.topn import top_n_per_group
from tracewright.session import table


def match_items(results: DataFrame) -> DataFrame:
    """One row per item of the lists; a row with a null or empty list keeps one row without an item."""
    return results.select("file_a", F.explode_outer("matched_files_b").alias("m")).select(
        "file_a", "m.rel_path_b", "m.shared_hash_count", "m.jaccard"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = match_items(table(spark, sf_dir, "deep_match_results"))
    return connected_groups(links, "file_a", "rel_path_b", record="rel_path", group="group_path")


def scored_items(results: DataFrame) -> DataFrame:
    return match_items(results).where("file_a is not null and rel_path_b is not null and jaccard is not null and not isnan(jaccard)")


def best_first() -> list[Column]:
    return [F.desc_nulls_last("jaccard"), F.desc_nulls_last("shared_hash_count"), F.asc("rel_path_b")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scored_items(table(spark, sf_dir, "deep_match_results"))
    return top_n_per_group(items, ["file_a"], ["rel_path_b"], best_first(), 5).select("file_a", "rel_path_b")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of each file with their scores and ranks."""
    items = scored_items(table(spark, sf_dir, "deep_match_results"))
    return top_n_per_group(items, ["file_a"], ["rel_path_b"], best_first(), 5, rank_name="match_rank")


_RANKED = """
WITH items AS (
  SELECT file_a, m.rel_path_b AS rel_path_b, m.shared_hash_count AS shared_hash_count, m.jaccard AS jaccard
  FROM (SELECT file_a, unnest(matched_files_b) AS m FROM deep_match_results WHERE file_a IS NOT NULL)),
once AS (
  SELECT * FROM items WHERE rel_path_b IS NOT NULL AND jaccard IS NOT NULL AND NOT isnan(jaccard)
  QUALIFY row_number() OVER (PARTITION BY file_a, rel_path_b ORDER BY jaccard DESC, shared_hash_count DESC NULLS LAST) = 1),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY file_a ORDER BY jaccard DESC, shared_hash_count DESC NULLS LAST, rel_path_b) AS INT) AS match_rank
  FROM once)
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_ranked": p4_ranked}

SQL = {
    "p1_found": """
WITH RECURSIVE items AS (
  SELECT file_a, unnest(matched_files_b).rel_path_b AS rel_path_b FROM deep_match_results),
named AS (
  SELECT file_a AS f FROM deep_match_results WHERE file_a IS NOT NULL UNION
  SELECT rel_path_b FROM items WHERE rel_path_b IS NOT NULL),
links AS (
  SELECT file_a AS x, rel_path_b AS y FROM items WHERE file_a IS NOT NULL AND rel_path_b IS NOT NULL UNION
  SELECT rel_path_b, file_a FROM items WHERE file_a IS NOT NULL AND rel_path_b IS NOT NULL),
reach AS (
  SELECT f AS rel_path, f AS g FROM named
  UNION
  SELECT l.y, r.g FROM reach r JOIN links l ON l.x = r.rel_path)
SELECT min(g) AS group_path, rel_path FROM reach GROUP BY rel_path""",
    "p4_found": _RANKED + "SELECT file_a, rel_path_b FROM ranked WHERE match_rank <= 5",
    "p4_ranked": _RANKED + "SELECT file_a, rel_path_b, shared_hash_count, jaccard, match_rank FROM ranked WHERE match_rank <= 5",
}
