"""Mixing sources to target shares of the total size, repeating no record more often than its source permits.

Sizes are summed per source with partial aggregation. The largest mix that meets every target share is bounded by
the source that its cap exhausts first; the repetition rate of each source follows. A record is emitted
floor(rate) times, plus once more with the probability of the fraction, drawn from a seeded hash of its id: the same
record gets the same draw in every run, partitioning and retry. No shuffle of records is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join
from tracewright.session import cut

SEED = 8_191


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, total, rate`` from ``sizes(source, total)`` and ``targets(source, target_share, max_repeats)``.

    Sources without records, without a positive target or without a cap of one or more get no rate and no row; the
    targets of the others are scaled to 1, so that their proportions hold. All are met at once, at the largest
    size that the caps permit: the rate of at least one source is its cap.
    """
    usable = F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & ~F.isnan("target_share")
    wanted = targets.where(usable).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = wanted.join(sizes.where(F.col("total") > 0), "source")
    # per unit of share, the size that the cap permits; its least over the sources bounds the mix
    held = cut(held)
    unit = held.agg(F.min(F.col("max_repeats") * F.col("total") / F.col("target_share"))).first()[0] or 0.0
    return held.select(
        "source",
        "target_share",
        "max_repeats",
        "total",
        F.least(F.col("max_repeats").cast("double"), F.lit(float(unit)) * F.col("target_share") / F.col("total")).alias("rate"),
    )


def mix(records: DataFrame, targets: DataFrame, *, id_col: str, source_col: str, size_col: str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(use of each record, shares of each source).

    ``use``: id, source, size, rate, ``copies`` of every record. Records of a null source, a null or no positive size, or a source that
    ``targets`` does not name (or names with no share) have no rate and 0 copies. Repeated ids get equal draws.
    ``shares``: source, target_share, max_repeats, rate, documents, tokens, used_documents, used_copies, used_tokens,
    actual_share; an empty table gives no rows. Other columns of ``records`` are left aside.
    """
    # written once: a size may be dear to compute, and a filter on it would compute it again
    every = cut(records.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")))
    rows = every.where("source is not null and size > 0")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("total"))
    rates = cut(source_rates(sizes, targets))
    rated = lookup_join(every, rates.select("source", "rate"), "source", "left").withColumn("rate", F.when(F.col("size") > 0, F.col("rate")))
    # 53 bits of the hash make a uniform draw in [0, 1)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) / F.lit(float(1 << 53))
    whole = F.floor("rate")
    drawn = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    used = rated.withColumn("copies", F.coalesce(drawn, F.lit(0)).cast("int"))
    summed = used.where("rate is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("size").alias("tokens"),
        F.sum((F.col("copies") > 0).cast("long")).alias("used_documents"),
        F.sum(F.col("copies").cast("long")).alias("used_copies"),
        F.sum(F.col("copies") * F.col("size")).alias("used_tokens"),
    )
    summed = cut(summed)
    all_tokens = summed.agg(F.sum("used_tokens")).first()[0] or 0
    share = F.when(F.lit(all_tokens > 0), F.col("used_tokens") / F.lit(float(max(all_tokens, 1)))).otherwise(0.0)
    shares = summed.join(rates.select("source", "target_share", "max_repeats", "rate"), "source").withColumn("actual_share", share)
    return used.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col).withColumnRenamed("size", size_col), shares


def emit_copies(use: DataFrame, copy_name: str = "copy") -> DataFrame:
    """The mix itself: each used record once per copy, numbered from 1."""
    return use.where("copies > 0").withColumn(copy_name, F.explode(F.sequence(F.lit(1), F.col("copies"))))
