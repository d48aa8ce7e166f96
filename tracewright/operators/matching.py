"""One-to-one matching of the files of two sides: equal paths first, then the most similar names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import basename, indel_ratio_udf
from tracewright.session import cut

THRESHOLD = 60.0
#: Candidate pairs up to which the assignment runs as one group; beyond, it runs in rounds over the cluster.
ONE_GROUP_PAIRS = 100_000
#: Parts into which the names of one length are dealt out.
DEALS = 16


def exact_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``rel_path_a, rel_path_b, similarity`` of paths on both sides; sides have one row per ``rel_path``."""
    both = a.select("rel_path").join(b.select("rel_path"), "rel_path")
    return both.select(F.col("rel_path").alias("rel_path_a"), F.col("rel_path").alias("rel_path_b"), F.lit(100.0).alias("similarity"))


def name_candidates(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of paths whose base names are similar enough: ``rel_path_a, rel_path_b, similarity``.

    A pair at threshold t needs lengths within a factor t / (200 - t), which makes this a band join on lengths; the common subsequence is
    computed once per pair of distinct names, by word operations. No filter on parts of names is exact at such thresholds, so
    the pairs grow with the product of distinct names of a band, as the definition demands.
    """
    names_a = a.select(basename(F.col("rel_path")).alias("name_a")).distinct().withColumn("la", F.length("name_a"))
    names_b = b.select(basename(F.col("rel_path")).alias("name_b")).distinct().withColumn("lb", F.length("name_b"))
    # the bound on lengths makes this a band join: each name meets those lengths in its band that the other side has (n lengths take n * n / 2
    # letters of names, so the broadcast stays small)
    ratio = threshold / (200.0 - threshold) if threshold > 0 else 0.0
    low, high = F.ceil(F.col("la") * F.lit(ratio) - F.lit(1e-9)), F.floor(F.col("la") / F.lit(ratio) + F.lit(1e-9)) if ratio else None
    in_band = F.col("lb") >= low if high is None else F.col("lb").between(low, high)
    banded = names_a.join(F.broadcast(names_b.select("lb").distinct()), in_band)
    # few lengths hold most names, so each band is dealt out over tasks by the A name; small as the rows are, the scoring is the work
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = banded.withColumn("deal", F.pmod(F.xxhash64("name_a"), F.lit(DEALS)).cast("int")).repartition(tasks, "lb", "deal")
    copied = names_b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))).repartition(tasks, "lb", "deal")
    near = dealt.join(copied, ["lb", "deal"])
    scored = near.select("name_a", "name_b", indel_ratio_udf("name_a", "name_b").alias("similarity")).where(F.col("similarity") >= threshold)
    paths_a = a.select(F.col("rel_path").alias("rel_path_a"), basename(F.col("rel_path")).alias("name_a"))
    paths_b = b.select(F.col("rel_path").alias("rel_path_b"), basename(F.col("rel_path")).alias("name_b"))
    return scored.join(paths_a, "name_a").join(paths_b, "name_b").select("rel_path_a", "rel_path_b", "similarity")


def pair_equal_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files with equal base names, paired in path order within each name."""

    def ranked(side: DataFrame, path: str) -> DataFrame:
        named = side.select(F.col("rel_path").alias(path), basename(F.col("rel_path")).alias("name"))
        return named.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(path)))

    both = ranked(a, "rel_path_a").join(ranked(b, "rel_path_b"), ["name", "n"])
    return both.select("rel_path_a", "rel_path_b", F.lit(100.0).alias("similarity"))


def greedy_assignment(candidates: DataFrame, one_group: int = ONE_GROUP_PAIRS) -> DataFrame:
    """One-to-one choice from scored pairs: best score first, ties by ``rel_path_a`` then ``rel_path_b``.

    Pairs that are the best of both their ends are final whatever the others do; they and all pairs that touch them leave, and so
    on. This equals the sequential choice. A remainder of bounded size ends in one group.
    """
    left = cut(candidates)
    chosen: list[DataFrame] = []
    order = [F.desc("similarity"), "rel_path_a", "rel_path_b"]
    while not left.isEmpty():
        if left.limit(one_group + 1).count() <= one_group:
            chosen.append(left.groupBy(F.lit(0).alias("g")).applyInPandas(_take, left.select("rel_path_a", "rel_path_b", "similarity").schema))
            break
        first = left.withColumn("ra", F.row_number().over(Window.partitionBy("rel_path_a").orderBy(*order))).withColumn(
            "rb", F.row_number().over(Window.partitionBy("rel_path_b").orderBy(*order))
        )
        best = cut(first.where("ra = 1 and rb = 1").select("rel_path_a", "rel_path_b", "similarity"))
        chosen.append(best)
        left = cut(left.join(best.select("rel_path_a"), "rel_path_a", "left_anti").join(best.select("rel_path_b"), "rel_path_b", "left_anti"))
    out = chosen[0] if chosen else left
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def _take(pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values(["similarity", "rel_path_a", "rel_path_b"], ascending=[False, True, True], kind="stable")
    used_a, used_b, rows = set(), set(), []
    for row in pairs[["rel_path_a", "rel_path_b", "similarity"]].itertuples(index=False):
        if row.rel_path_a not in used_a and row.rel_path_b not in used_b:
            used_a.add(row.rel_path_a)
            used_b.add(row.rel_path_b)
            rows.append(row)
    return pd.DataFrame(rows, columns=["rel_path_a", "rel_path_b", "similarity"])


def match_files(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, unmatched of a, unmatched of b). Sides have a column ``rel_path``; null paths are left out and repeated ones count once."""
    a, b = (cut(x.select("rel_path").where("rel_path is not null").distinct()) for x in (a, b))
    exact = cut(exact_pairs(a, b))
    rest_a, rest_b = without(a, exact, "rel_path_a"), without(b, exact, "rel_path_b")
    named = cut(pair_equal_names(rest_a, rest_b)) if threshold <= 100 else exact.limit(0)
    far_a, far_b = without(rest_a, named, "rel_path_a"), without(rest_b, named, "rel_path_b")
    fuzzy = greedy_assignment(name_candidates(far_a, far_b, threshold)) if threshold < 100 else exact.limit(0)
    matches = cut(exact.unionByName(named).unionByName(fuzzy.select(*exact.columns)))
    return matches, without(a, matches, "rel_path_a"), without(b, matches, "rel_path_b")


def without(side: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    """Files of a side that no match names."""
    return side.join(matches.select(F.col(column).alias("rel_path")), "rel_path", "left_anti")


def keep_listed(matches: DataFrame, listed: DataFrame) -> DataFrame:
    """Matches whose A path is in ``listed(rel_path)``."""
    return matches.join(listed.select(F.col("rel_path").alias("rel_path_a")).distinct(), "rel_path_a", "left_semi").select(*matches.columns)
