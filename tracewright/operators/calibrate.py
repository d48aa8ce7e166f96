"""Error rates of thresholds over labelled pair scores (``case_name, mode, label, level, jaccard, tokens_min``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join

#: Cases whose originals, two fingerprint sets each, may be broadcast.
CASES = 2_000
#: Token bounds of the size bins.
SMALL, LARGE = 150, 600
LEVELS = (1, 2, 3, 4, 5, 6)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def size_bin(tokens: Column) -> Column:
    return F.when(tokens < SMALL, "small").when(tokens < LARGE, "medium").otherwise("large")


def passed(scores: DataFrame) -> DataFrame:
    """Scores with ``top``: the largest whole threshold in 0..100 that they reach, or null. A comparison with t is then ``top >= t``."""
    reached = F.col("jaccard") * 100
    floor = F.floor(reached).cast("int")
    return scores.withColumn("top", F.when(reached >= 0, F.least(floor, F.lit(100))))


def sweep(scores: DataFrame) -> DataFrame:
    """One row per mode and threshold 0..100: false-positive rates in all and by size, recall in all and by level.

    Scores are first reduced to counts per mode, label, level, size and reached threshold, so the sweep costs one pass over
    them, whatever the number of thresholds.
    """
    counted = passed(scores).groupBy("mode", "label", "level", size_bin(F.col("tokens_min")).alias("bin"), "top").agg(F.count(F.lit(1)).alias("n"))
    grid = counted.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(100))))
    hit = F.coalesce(F.col("top") >= F.col("threshold"), F.lit(False))

    def share(where: Column) -> Column:
        return rate(F.sum(F.when(where & hit, F.col("n")).otherwise(0)), F.sum(F.when(where, F.col("n")).otherwise(0)))

    neg, pos = F.col("label") == "neg", F.col("label") == "pos"
    return grid.groupBy("mode", "threshold").agg(
        share(neg).alias("fp_rate"),
        *(share(neg & (F.col("bin") == b)).alias(f"fp_{b}") for b in ("small", "medium", "large")),
        *(share(pos & (F.col("level") == v)).alias(f"recall_L{v}") for v in LEVELS),
        share(pos).alias("recall_all"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in per cent; 0 and 0 for no trials."""
    p = k / n
    base = F.lit(1.0) + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (2 * n)) / base
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / base
    none = F.lit(0.0)
    return (
        F.when(n > 0, F.greatest(none, center - half) * 100).otherwise(none),
        F.when(n > 0, F.least(F.lit(1.0), center + half) * 100).otherwise(none),
    )


def false_positives(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Flagged and all negatives with rate and interval, per ``by``."""
    flagged = F.sum((F.col("jaccard") * 100 >= threshold).cast("long"))
    counted = scores.where("label = 'neg'").groupBy(*by).agg(flagged.alias("flagged"), F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("flagged"), F.col("total"))
    return counted.withColumns({"fp_rate": rate(F.col("flagged"), F.col("total")), "ci_low": low, "ci_high": high})


def frontier(scores: DataFrame, fp_target: float = 5.0, mode: str = "normalize") -> DataFrame:
    """For every token floor: the least threshold whose false positives at or above the floor meet the target, with recall and coverage.

    Floors are the distinct token counts. Counts per floor and reached threshold are cumulated by windows over (floor, threshold)
    cells instead of comparing each floor with each score.
    """
    own = passed(scores.where(F.col("mode") == mode))
    cells = own.groupBy(F.col("tokens_min").alias("floor"), F.coalesce("top", F.lit(-1)).alias("top")).agg(
        F.sum((F.col("label") == "neg").cast("long")).alias("neg"), F.sum((F.col("label") == "pos").cast("long")).alias("pos")
    )
    # at or above the floor, per reached threshold: cumulate along floors, the thresholds being at most 102 rows a floor
    floors = scores.select(F.col("tokens_min").alias("floor")).distinct()
    full = floors.withColumn("top", F.explode(F.sequence(F.lit(-1), F.lit(100)))).join(cells, ["floor", "top"], "left").na.fill(0, ["neg", "pos"])
    above = Window.partitionBy("top").orderBy(F.desc("floor"))
    cumulated = full.select("floor", "top", F.sum("neg").over(above).alias("neg"), F.sum("pos").over(above).alias("pos"))
    reach = Window.partitionBy("floor").orderBy(F.desc("top"))
    whole = Window.partitionBy("floor")
    points = cumulated.select(
        "floor",
        F.col("top").alias("threshold"),
        F.sum("neg").over(reach).alias("fp"),
        F.sum("pos").over(reach).alias("tp"),
        F.sum("neg").over(whole).alias("negs"),
        F.sum("pos").over(whole).alias("poss"),
    ).where("threshold >= 0 and negs > 0")
    good = points.where(rate(F.col("fp"), F.col("negs")) <= fp_target)
    first = good.withColumn("n", F.row_number().over(Window.partitionBy("floor").orderBy("threshold"))).where("n = 1")
    total = own.agg(F.sum((F.col("label") == "neg").cast("long"))).first()[0] or 0
    return first.select(
        "floor", "threshold", rate(F.col("fp"), F.col("negs")).alias("fp_rate"), rate(F.col("tp"), F.col("poss")).alias("recall"), (F.col("negs") / F.lit(float(max(total, 1)))).alias("coverage")
    )


def recommended(points: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """The point with the highest recall among those that still judge enough negatives; the lowest floor of equal ones."""
    return points.where(F.col("coverage") >= min_coverage).orderBy(F.desc("recall"), "floor").limit(1)


def confusion(scores: DataFrame, threshold: float, mode: str = "raw") -> DataFrame:
    """Precision, recall and F1 in per cent of a threshold in per cent."""
    hit = F.col("jaccard") * 100 >= threshold
    count = lambda c: F.sum(c.cast("long"))
    pos = F.col("label") == "pos"
    one = scores.where(F.col("mode") == mode).agg(count(pos & hit).alias("tp"), count(~pos & hit).alias("fp"), count(pos & ~hit).alias("fn"), count(~pos & ~hit).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def pair_scores(docs: DataFrame, original: Column) -> DataFrame:
    """Scores of each case's original against its other submissions, in both channels, from ``case_name, doc_key, level, raw_fp, norm_fp, tokens``.

    One row per submission is expected. Submissions with a level are positives, others negatives; an empty union scores 0.
    """
    first = docs.where(original).select("case_name", *(F.col(c).alias(f"o_{c}") for c in ("raw_fp", "norm_fp", "tokens")))
    both = lookup_join(docs.where(~original), first, "case_name", "inner", broadcast_rows=CASES)

    def score(fp: str) -> Column:
        x, y = (F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<bigint>")), lambda v: v.isNotNull())) for c in (F.col(fp), F.col(f"o_{fp}")))
        shared = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - shared
        return F.when(union > 0, shared / union).otherwise(0.0)

    label = F.when(F.col("level").isNotNull(), "pos").otherwise("neg")
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), score(c).alias("jaccard")) for m, c in (("raw", "raw_fp"), ("normalize", "norm_fp"))))
    return both.select("case_name", "doc_key", label.alias("label"), "level", F.least("tokens", "o_tokens").alias("tokens_min"), F.inline(modes))
