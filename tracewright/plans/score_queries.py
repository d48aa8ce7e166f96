"""Queries of threshold calibration, over submission_docs and file_matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import calibrate
from tracewright.operators.skew import lookup_join
from tracewright.session import cut, table


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per submission; repeated rows hold the same sets, in another order maybe."""
    rows = table(spark, sf_dir, "submission_docs").where("doc_key is not null")
    firsts = [F.min_by(F.struct("case_name", "level", "raw_fp", "norm_fp"), "received_at").alias("x"), F.max("tokens").alias("tokens")]
    return rows.groupBy("doc_key").agg(*firsts).select("doc_key", "x.*", "tokens")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's first submission against its others."""
    docs = cut(submissions(spark, sf_dir).where("case_name is not null"))
    firsts = docs.groupBy("case_name").agg(F.min("doc_key").alias("first_key"))
    return calibrate.pair_scores(lookup_join(docs, firsts, "case_name", "inner"), F.col("doc_key") == F.col("first_key")).where("tokens_min is not null")


def q_pair_scores(spark, sf):
    return scores(spark, sf)


def q_quality_sweep(spark, sf):
    return calibrate.sweep(scores(spark, sf))


def q_frontier(spark, sf):
    return calibrate.frontier(cut(scores(spark, sf)), 5.0)


def q_frontier_recommended(spark, sf):
    return calibrate.recommended(calibrate.frontier(cut(scores(spark, sf)), 5.0))


def q_wilson(spark, sf):
    return calibrate.false_positives(scores(spark, sf), 50.0, ["mode"])


def q_per_case_fp(spark, sf):
    return calibrate.false_positives(scores(spark, sf), 50.0, ["mode", "case_name"])


def q_confusion(spark, sf):
    return calibrate.confusion(scores(spark, sf), 40.0)


def q_exhibit_index(spark, sf):
    """Matches in order with their page ranges, a page per started ten points of similarity lost."""
    rows = table(spark, sf, "file_matches").where("rel_path_a is not null and rel_path_b is not null and similarity is not null")
    once = rows.groupBy("run_id", "rel_path_a", "rel_path_b").agg(F.max("similarity").alias("similarity"))
    paged = once.withColumn("pages", (F.floor((100 - F.col("similarity")) / 10) + 1).cast("long"))
    order = Window.partitionBy("run_id").orderBy("rel_path_a", "rel_path_b")
    last = F.sum("pages").over(order)
    return paged.select("run_id", F.row_number().over(order).cast("long").alias("exhibit"), "rel_path_a", "rel_path_b", "similarity", (last - F.col("pages") + 1).alias("first_page"), last.alias("last_page"))


_SCORES = """
WITH one AS (
  SELECT doc_key, min_by(case_name, received_at) AS case_name, min_by(level, received_at) AS level, max(tokens) AS tokens,
    list_sort(list_distinct(list_filter(coalesce(any_value(raw_fp), []), lambda x: x IS NOT NULL))) AS raw, list_sort(list_distinct(list_filter(coalesce(any_value(norm_fp), []), lambda x: x IS NOT NULL))) AS norm
  FROM submission_docs WHERE doc_key IS NOT NULL GROUP BY doc_key),
lev AS (SELECT doc_key, level FROM submission_docs QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY received_at) = 1),
d AS (SELECT one.* EXCLUDE (level), lev.level, row_number() OVER (PARTITION BY case_name ORDER BY doc_key) AS n FROM one JOIN lev USING (doc_key) WHERE case_name IS NOT NULL),
p AS (SELECT c.case_name, c.doc_key, CASE WHEN c.level IS NOT NULL THEN 'pos' ELSE 'neg' END AS label, c.level,
  CASE WHEN c.tokens IS NULL THEN o.tokens WHEN o.tokens IS NULL THEN c.tokens ELSE least(c.tokens, o.tokens) END AS tokens_min, c.raw, o.raw AS oraw, c.norm, o.norm AS onorm
  FROM d c JOIN d o ON o.case_name = c.case_name AND o.n = 1 WHERE c.n > 1),
u AS (SELECT case_name, doc_key, label, level, tokens_min, 'raw' AS mode, raw AS x, oraw AS y FROM p UNION ALL SELECT case_name, doc_key, label, level, tokens_min, 'normalize', norm, onorm FROM p),
s AS (SELECT case_name, doc_key, label, level, tokens_min, mode,
  CASE WHEN len(x) + len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) END AS jaccard FROM u WHERE tokens_min IS NOT NULL)"""


def _share(where: str) -> str:
    return f"CASE WHEN count(*) FILTER ({where}) > 0 THEN count(*) FILTER ({where} AND jaccard * 100 >= threshold) / CAST(count(*) FILTER ({where}) AS DOUBLE) * 100 ELSE 0.0 END"


_BINS = {"small": "tokens_min < 150", "medium": "tokens_min >= 150 AND tokens_min < 600", "large": "tokens_min >= 600"}
_FRONTIER = (
    _SCORES
    + """, own AS (SELECT * FROM s WHERE mode = 'normalize'), floors AS (SELECT DISTINCT tokens_min AS floor FROM s),
grid AS (SELECT floor, t.threshold, count(*) FILTER (label = 'neg') AS negs, count(*) FILTER (label = 'pos') AS poss,
  count(*) FILTER (label = 'neg' AND jaccard * 100 >= t.threshold) AS fp, count(*) FILTER (label = 'pos' AND jaccard * 100 >= t.threshold) AS tp
  FROM floors JOIN own ON tokens_min >= floor, (SELECT unnest(range(0, 101))::INT AS threshold) t GROUP BY floor, t.threshold),
points AS (SELECT floor, threshold, fp / CAST(negs AS DOUBLE) * 100 AS fp_rate, CASE WHEN poss > 0 THEN tp / CAST(poss AS DOUBLE) * 100 ELSE 0.0 END AS recall,
  negs / CAST((SELECT count(*) FROM own WHERE label = 'neg') AS DOUBLE) AS coverage
  FROM grid WHERE negs > 0 AND fp / CAST(negs AS DOUBLE) * 100 <= 5.0 QUALIFY row_number() OVER (PARTITION BY floor ORDER BY threshold) = 1)"""
)


def _false_positives(by: str) -> str:
    return (
        _SCORES
        + f""", c AS (SELECT {by}, count(*) FILTER (jaccard * 100 >= 50) AS flagged, count(*) AS total FROM s WHERE label = 'neg' GROUP BY {by}),
i AS (SELECT *, flagged / CAST(total AS DOUBLE) AS p, 1.96 * 1.96::DOUBLE AS zz FROM (SELECT *, 1.96::DOUBLE AS z FROM c)),
j AS (SELECT *, (p + 3.8415999999999997::DOUBLE / (2 * total)) / (1.0 + 3.8415999999999997::DOUBLE / total) AS center, 1.96::DOUBLE * sqrt(p * (1 - p) / total + 3.8415999999999997::DOUBLE / (4 * total * total)) / (1.0 + 3.8415999999999997::DOUBLE / total) AS half FROM i)
SELECT {by}, flagged, total, p * 100 AS fp_rate, greatest(0.0, center - half) * 100 AS ci_low, least(1.0, center + half) * 100 AS ci_high FROM j"""
    )


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "pair_scores": _SCORES + " SELECT case_name, doc_key, label, level, tokens_min, mode, jaccard FROM s",
    "quality_sweep": _SCORES
    + " SELECT mode, threshold, "
    + ", ".join([f"{_share(chr(39).join(['label = ', 'neg', '']))} AS fp_rate", *(f"{_share(f'label = {chr(39)}neg{chr(39)} AND {c}')} AS fp_{b}" for b, c in _BINS.items()), *(f"{_share(f'label = {chr(39)}pos{chr(39)} AND level = {v}')} AS recall_L{v}" for v in calibrate.LEVELS), f"{_share(chr(39).join(['label = ', 'pos', '']))} AS recall_all"])
    + " FROM s, (SELECT unnest(range(0, 101))::INT AS threshold) t GROUP BY mode, threshold",
    "frontier": _FRONTIER + " SELECT floor, threshold, fp_rate, recall, coverage FROM points",
    "frontier_recommended": _FRONTIER + " SELECT floor, threshold, fp_rate, recall, coverage FROM points WHERE coverage >= 0.5 ORDER BY recall DESC, floor LIMIT 1",
    "wilson": _false_positives("mode"),
    "per_case_fp": _false_positives("mode, case_name"),
    "confusion": _SCORES
    + """, c AS (SELECT count(*) FILTER (label = 'pos' AND jaccard * 100 >= 40) AS tp, count(*) FILTER (label <> 'pos' AND jaccard * 100 >= 40) AS fp,
count(*) FILTER (label = 'pos' AND NOT jaccard * 100 >= 40) AS fn, count(*) FILTER (label <> 'pos' AND NOT jaccard * 100 >= 40) AS tn FROM s WHERE mode = 'raw')
SELECT tp, fp, fn, tn, tp / CAST(tp + fp AS DOUBLE) * 100 AS precision, tp / CAST(tp + fn AS DOUBLE) * 100 AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) * 100 AS f1 FROM c""",
    "exhibit_index": """
WITH once AS (SELECT run_id, rel_path_a, rel_path_b, max(similarity) AS similarity FROM file_matches WHERE rel_path_a IS NOT NULL AND rel_path_b IS NOT NULL AND similarity IS NOT NULL GROUP BY 1, 2, 3),
paged AS (SELECT *, CAST(floor((100 - similarity) / 10) AS BIGINT) + 1 AS pages FROM once)
SELECT run_id, row_number() OVER w AS exhibit, rel_path_a, rel_path_b, similarity, CAST(sum(pages) OVER w - pages + 1 AS BIGINT) AS first_page, CAST(sum(pages) OVER w AS BIGINT) AS last_page
FROM paged WINDOW w AS (PARTITION BY run_id ORDER BY rel_path_a, rel_path_b)""",
}
