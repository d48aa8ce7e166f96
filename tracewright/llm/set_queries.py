"""Problem 3: similar fingerprint sets of submissions and similar sets of matched files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.match_queries import match_items
from tracewright.llm.setjoin import add_long_links, expand_pairs, link_counts, long_set_keys, long_set_pairs, sets_of_arrays, sets_of_rows, similar_classes
from tracewright.session import cut, table

THRESHOLD, MIN_SIZE = 0.7, 3


def _classes(spark: SparkSession, sf_dir: str):
    """Members, pairs, and the keys and the pairs of sets too long for a row. A key is a letter for the mode and the record's key; raw and normalize go through one run."""
    docs = table(spark, sf_dir, "submission_docs").where("doc_key is not null")
    both = [docs.select(F.concat(F.lit(letter), "doc_key").alias("key"), F.col(column).alias("set")) for letter, column in (("r", "raw_fp"), ("n", "norm_fp"))]
    prints = sets_of_arrays(both[0].unionByName(both[1]), "key", "set", MIN_SIZE)
    yield *similar_classes(prints, THRESHOLD, apart=F.substring("key", 1, 1)), None, None
    items = match_items(table(spark, sf_dir, "deep_match_results")).withColumn("file_a", F.concat(F.lit("m"), "file_a"))
    short, long_rows = sets_of_rows(items, "file_a", "rel_path_b", MIN_SIZE, threshold=THRESHOLD)
    yield *similar_classes(short, THRESHOLD), long_set_keys(long_rows), long_set_pairs(long_rows, THRESHOLD)


def _named(key: str) -> tuple[Column, Column]:
    """Mode and record of a key with its letter."""
    letter = F.substring(key, 1, 1)
    return F.when(letter == "r", "raw").when(letter == "n", "normalize").otherwise("matched").alias("mode"), F.substring(key, 2, 1 << 30)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for members, pairs, _, long_pairs in _classes(spark, sf_dir):
        found = expand_pairs(members, pairs).select("key_1", "key_2")
        if long_pairs is not None:
            found = found.unionByName(long_pairs.select(F.col("key_a").alias("key_1"), F.col("key_b").alias("key_2")))
        mode, key_1 = _named("key_1")
        parts.append(found.select(mode, key_1.alias("key_1"), _named("key_2")[1].alias("key_2")))
    return reduce(DataFrame.unionByName, parts)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mode and record: its class of equal sets and its number of links. Copies are not expanded."""
    parts = []
    for members, pairs, long_keys, long_pairs in _classes(spark, sf_dir):
        counts = link_counts(cut(members), cut(pairs))
        if long_pairs is not None:
            counts = add_long_links(counts, long_keys, cut(long_pairs))
        mode, key = _named("key")
        parts.append(counts.select(mode, key.alias("key"), _named("class_key")[1].alias("class_key"), "n_links"))
    return reduce(DataFrame.unionByName, parts)


_PAIRS = """
WITH v AS (
  SELECT DISTINCT 'raw' AS mode, doc_key AS k, CAST(unnest(raw_fp) AS VARCHAR) AS x FROM submission_docs UNION
  SELECT DISTINCT 'normalize', doc_key, CAST(unnest(norm_fp) AS VARCHAR) FROM submission_docs UNION
  SELECT DISTINCT 'matched', file_a, unnest(matched_files_b).rel_path_b FROM deep_match_results WHERE file_a IS NOT NULL),
s AS (SELECT mode, k, count(x) AS n FROM v WHERE x IS NOT NULL AND k IS NOT NULL GROUP BY mode, k HAVING count(x) >= 3),
w AS (SELECT mode, k, x, n FROM v JOIN s USING (mode, k) WHERE x IS NOT NULL),
pairs AS (
  SELECT a.mode AS mode, a.k AS key_1, b.k AS key_2, count(*) AS shared, any_value(a.n) AS n1, any_value(b.n) AS n2
  FROM w a JOIN w b ON a.mode = b.mode AND a.x = b.x AND a.k < b.k GROUP BY a.mode, a.k, b.k),
found AS (SELECT mode, key_1, key_2 FROM pairs WHERE shared / CAST(n1 + n2 - shared AS DOUBLE) >= 0.7)
"""

QUERIES = {"p3_found": p3_found, "p3_links": p3_links}

SQL = {
    "p3_found": _PAIRS + "SELECT mode, key_1, key_2 FROM found",
    "p3_links": _PAIRS
    + """, sets AS (SELECT mode, k, string_agg(x, '|' ORDER BY x) AS content FROM w GROUP BY mode, k),
linked AS (
  SELECT mode, k, count(*) AS n FROM (SELECT mode, key_1 AS k FROM found UNION ALL SELECT mode, key_2 FROM found) GROUP BY mode, k)
SELECT mode, k AS key, min(k) OVER (PARTITION BY mode, content) AS class_key, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM sets LEFT JOIN linked USING (mode, k)""",
}
