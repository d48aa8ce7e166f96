"""All pairs of records whose sets of values overlap above a Jaccard threshold.

Minwise hash signatures are split into bands; records that share the bucket of any band are candidates; candidates
are deduplicated and verified by exact set similarity. Records with equal sets form one class first, so that a large group
of copies costs one signature and no candidates. A bucket with more classes than ``BUCKET_CLASSES``
is not paired within: its classes go through an exact prefix join instead (two sets above the threshold share one of
the values that are rarest in each), so nothing is lost to a cap. Sets too long for one row are counted relationally.

With 48 bands of 4 rows a pair at similarity 0.7 is missed with probability (1 - 0.7^4)^48 = 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join
from tracewright.session import cut

BANDS, ROWS = 48, 4
BUCKET_CLASSES = 400
#: Values up to which a set is held in one row.
ROW_VALUES = 50_000
SEED = 20_240_229


def _parameters(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(SEED))
    n = bands * rows
    return draw.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_buckets(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Bucket of each band for each set of 64-bit values, shape (sets, bands). Sets must not be empty."""
    a, b = _parameters(bands, rows)
    sizes = np.array([len(s) for s in sets])
    values = _mix(np.concatenate(sets).astype(np.int64).view(np.uint64))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            low = np.minimum.reduceat(_mix(values * a[i] + b[i]), starts)
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out.view(np.int64)


def buckets_column(values: Column, bands: int, rows: int, part: Column) -> Column:
    """Buckets of a set; sets of different parts share none."""

    @F.pandas_udf("array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sets = [np.asarray(s, np.int64) for s in batch]
            parts: list = []
            # a bounded number of values at once, whatever the lengths of the sets
            at = 0
            while at < len(sets):
                end, held = at, 0
                while end < len(sets) and (end == at or held + len(sets[end]) <= 1_000_000):
                    held += len(sets[end])
                    end += 1
                parts.extend(band_buckets(sets[at:end], bands, rows))
                at = end
            yield pd.Series(parts)

    return of(F.transform(values, lambda v: F.xxhash64(part, v)))


def sets_of_arrays(df: DataFrame, key: str, values: str, min_size: int = 1) -> DataFrame:
    """``key, set, size``: the distinct non-null values of all rows of a key, sorted. Null keys and sets below ``min_size`` are left out."""
    distinct = F.array_sort(F.array_distinct(F.filter(F.col(values), lambda v: v.isNotNull())))
    rows = df.where(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(key).alias("key"), distinct.alias("set"))
    grouped = rows.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("set")))).alias("set"))
    return grouped.select("key", "set", F.size("set").alias("size")).where(F.col("size") >= min_size)


def sets_of_rows(df: DataFrame, key: str, value: str, min_size: int = 1, *, threshold: float, row_values: int = ROW_VALUES) -> tuple[DataFrame, DataFrame]:
    """Sets given as one row per key and value: (``key, set, size`` up to ``row_values``, ``key, value, size`` of the longer ones and of all that may pair with one).

    Sizes are counted before any set is gathered, so no task holds more than ``row_values`` values of a key. Two sets reach ``threshold``
    only if the smaller has that share of the larger one's size, so sets from ``threshold * row_values`` on meet the long ones, whatever the threshold.
    """
    rows = cut(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value")).distinct())
    sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size")).where(F.col("size") >= min_size))
    sized = lookup_join(rows, sizes, "key", "inner")
    short = sized.where(F.col("size") <= row_values).groupBy("key", "size").agg(F.array_sort(F.collect_list("value")).alias("set"))
    return short.select("key", "set", "size"), sized.where(F.col("size") >= F.lit(threshold - 1e-9) * F.lit(row_values))


def _may_match(a: str, b: str, threshold: float) -> Column:
    """Size bound of the Jaccard similarity, a little wide against rounding; the exact check follows."""
    return F.least(F.col(a), F.col(b)) >= F.lit(threshold - 1e-9) * F.greatest(F.col(a), F.col(b))


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs by an exact prefix join: values ordered by how many sets hold them, rarest first."""
    tokens = sets.select("rep", "part", "size", F.explode("set").alias("value"))
    often = cut(tokens.groupBy("value", "part").agg(F.count(F.lit(1)).alias("n")))
    ranked = lookup_join(tokens, often, ["value", "part"], "inner")
    ordered = ranked.groupBy("rep", "part", "size").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("o"))
    keep = F.col("size") - F.ceil(F.col("size") * F.lit(threshold - 1e-9)).cast("int") + 1
    prefix = ordered.select("rep", "part", "size", F.explode(F.slice("o", F.lit(1), keep)).alias("t")).select("rep", "part", "size", "t.value")
    a = prefix.select("value", "part", F.col("rep").alias("rep_a"), F.col("size").alias("size_a"))
    b = prefix.select("value", "part", F.col("rep").alias("rep_b"), F.col("size").alias("size_b"))
    return a.join(b, ["value", "part"]).where((F.col("rep_a") < F.col("rep_b")) & _may_match("size_a", "size_b", threshold)).select("rep_a", "rep_b").distinct()


def similar_classes(
    sets: DataFrame, threshold: float, *, bands: int = BANDS, rows: int = ROWS, bucket_classes: int = BUCKET_CLASSES, apart: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members ``key, rep``, pairs ``rep_a, rep_b, jaccard``) of ``sets(key, set, size)``, one row per key.

    Keys with equal sets have one class, named by the smallest key; pairs are of different classes with
    ``rep_a < rep_b``. Sets must be sorted, distinct and not empty. No sets give no rows. ``apart``, an expression over ``key``, keeps
    collections apart that go through one run: only sets for which it is equal are compared.

    A set that a large share of all keys holds is one class; its keys find their class by a lookup that spreads them.
    """
    part = F.lit(0) if apart is None else apart
    digest = F.concat_ws(":", F.xxhash64(part, "set"), F.xxhash64(F.lit(SEED), part, "set"), "size")
    sets = cut(sets.select("key", "set", "size", part.alias("part"), digest.alias("digest")))
    # all sets of a digest are equal, so any of them is the class's
    heads = cut(sets.groupBy("digest").agg(F.min("key").alias("rep"), F.first("part").alias("part"), F.first("size").alias("size"), F.first("set").alias("set")))
    members = lookup_join(sets.select("key", "digest"), heads.select("digest", "rep"), "digest", "inner").select("key", "rep")
    heads = heads.select("rep", "part", "size", "set")
    spread = heads.select("rep", "size", F.posexplode(buckets_column(F.col("set"), bands, rows, F.col("part"))).alias("band", "bucket"))
    spread = cut(spread)
    crowded = cut(spread.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_classes))
    both = ["band", "bucket"]
    if crowded.isEmpty():
        few, extra = spread, None
    else:
        few = spread.join(crowded, both, "left_anti")
        late = spread.join(crowded, both, "left_semi").select("rep").distinct()
        extra = _prefix_pairs(heads.join(late, "rep", "left_semi"), threshold)
    a = few.select(*both, F.col("rep").alias("rep_a"), F.col("size").alias("size_a"))
    b = few.select(*both, F.col("rep").alias("rep_b"), F.col("size").alias("size_b"))
    pairs = a.join(b, both).where((F.col("rep_a") < F.col("rep_b")) & _may_match("size_a", "size_b", threshold)).select("rep_a", "rep_b").distinct()
    if extra is not None:
        pairs = pairs.unionByName(extra).distinct()
    left = heads.select(F.col("rep").alias("rep_a"), F.col("set").alias("set_a"))
    right = heads.select(F.col("rep").alias("rep_b"), F.col("set").alias("set_b"))
    checked = pairs.join(left, "rep_a").join(right, "rep_b")
    shared = checked.select("rep_a", "rep_b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"), F.size(F.array_intersect("set_a", "set_b")).alias("n"))
    scored = shared.select("rep_a", "rep_b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
    return members, scored.where(F.col("jaccard") >= threshold)


def long_set_keys(long_rows: DataFrame, row_values: int = ROW_VALUES) -> DataFrame:
    """``key`` of each set longer than ``row_values``, whether it has a partner or not, from ``key, value, size`` rows."""
    return long_rows.where(F.col("size") > row_values).select("key").distinct()


def long_set_pairs(long_rows: DataFrame, threshold: float, row_values: int = ROW_VALUES) -> DataFrame:
    """``key_a, key_b, jaccard`` of pairs in which one set is longer than ``row_values``, from ``key, value, size`` rows.

    Each value meets the few sets of such length that hold it; shared values are counted with partial
    aggregation, and no set is gathered.
    """
    a = long_rows.select("value", F.col("key").alias("key_a"), F.col("size").alias("size_a"))
    b = long_rows.select("value", F.col("key").alias("key_b"), F.col("size").alias("size_b"))
    pairs = a.join(b, "value").where(
        (F.col("key_a") < F.col("key_b")) & _may_match("size_a", "size_b", threshold) & (F.greatest("size_a", "size_b") > row_values)
    )
    counted = pairs.groupBy("key_a", "key_b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"))
    jaccard = F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))
    return counted.select("key_a", "key_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key_1, key_2, jaccard`` with ``key_1 < key_2``: all pairs of records, those within a class among them."""
    one = members.select(F.col("key").alias("x"), F.col("rep").alias("rep_a"))
    two = members.select(F.col("key").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.join(one, "rep_a").join(two, "rep_b").select("x", "y", "jaccard")
    inside = one.join(two, (F.col("rep_a") == F.col("rep_b")) & (F.col("x") < F.col("y"))).select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.unionByName(inside).select(F.least("x", "y").alias("key_1"), F.greatest("x", "y").alias("key_2"), "jaccard")


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, class_key, n_links``: one row per record, its class and with how many other records it is linked. Nothing is expanded."""
    sizes = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    ends = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    linked = ends.join(sizes.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("m"))
    totals = sizes.join(linked, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return lookup_join(members, totals, "rep", "inner").select("key", F.col("rep").alias("class_key"), "n_links")


def add_long_links(counts: DataFrame, long_keys: DataFrame, long_pairs: DataFrame) -> DataFrame:
    """``link_counts`` of the short sets, completed by the sets too long for a row: each has a row, also without a partner.

    Equal long sets are pairs of jaccard 1, so the smallest key of a class is an end of a pair with each other key of it.
    """
    head = F.when(F.col("jaccard") == 1, F.col("key_a"))
    ends = long_pairs.select(F.col("key_a").alias("key"), F.lit(None).cast(long_pairs.schema["key_a"].dataType).alias("head"), F.lit(1).alias("n"))
    ends = ends.unionByName(long_pairs.select(F.col("key_b").alias("key"), head.alias("head"), F.lit(1).alias("n")))
    ends = ends.unionByName(long_keys.select("key", F.lit(None).cast(long_keys.schema["key"].dataType).alias("head"), F.lit(0).alias("n")))
    more = ends.groupBy("key").agg(F.min("head").alias("head"), F.sum("n").alias("more"))
    return counts.join(more, "key", "full").select(
        "key", F.coalesce("class_key", "head", "key").alias("class_key"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links")
    )
