"""Per-key work without the imbalance that a few very frequent keys cause.

Heavy keys come from a frequent-items sketch over all rows. Their number is bounded by the sketch's
parameters, so the list of them may be broadcast at any input size. Rows of heavy keys are aggregated in
two steps that never gather a key in one task before it is reduced; all other rows go through an
ordinary shuffle on the key; the two results are put together by a union.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import cut, fresh

#: A key is heavy from this part of a mean shuffle partition on, and in any case from ``HEAVY_SHARE`` of all rows on. The share has a
#: floor, so that the list of heavy keys, at most 2 / share of them, may always be broadcast.
HEAVY_PART, HEAVY_SHARE, LEAST_SHARE = 0.5, 0.001, 2e-5
SKETCH_ITEMS = 16_384
#: Rows up to which a lookup side is broadcast; beyond, heavy keys are split off instead.
BROADCAST_ROWS = 200_000


def heavy_share(spark: SparkSession) -> float:
    """Share of all rows from which a key is heavy: what half a mean partition holds, so that no task gets much more than a mean one."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SHARE, min(HEAVY_SHARE, HEAVY_PART / max(partitions, 1)))


def heavy_keys(df: DataFrame, key: str, *, share: float | None = None, items: int = SKETCH_ITEMS) -> list:
    """Values of ``key`` that hold about ``share`` of the rows or more (``heavy_share`` unless given); at most ``2 / share`` of them.

    One pass with partial aggregation. Nulls never count. The sketch may add a value a little under the
    share or, near it, leave one out; what uses the list must be right with any list.
    """
    share = share or heavy_share(df.sparkSession)
    most = int(2 / share)
    row = df.agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {max(items, 2 * most)})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if row is None or not row["top"]:
        return []
    return [x["item"] for x in row["top"] if x["item"] is not None and x["count"] >= share * row["n"]]


def split_heavy(df: DataFrame, key: str, heavy: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys (by a broadcast join with the bounded list), and all other rows, null keys among them."""
    spark, kind = df.sparkSession, df.schema[key].dataType
    name = fresh(df, "heavy")
    listed = F.broadcast(spark.createDataFrame([(x,) for x in heavy], f"`{name}` {kind.simpleString()}"))
    on = F.col(key) == F.col(name)
    return df.join(listed, on, "left_semi"), df.join(listed, on, "left_anti")


def count_distinct_rows(
    df: DataFrame,
    keys: Sequence[str],
    identity: Sequence[str],
    *,
    skew_key: str | None = None,
    heavy: Sequence | None = None,
    count_name: str = "n_rows",
) -> DataFrame:
    """Number of rows of each combination of ``keys``, rows that agree in ``identity`` and ``keys`` counting once.

    Output: the keys and ``count_name`` bigint. Nulls in keys form groups of their own, as in GROUP BY; an
    empty input gives no rows; other columns are left aside. ``skew_key`` (the first key unless given) is
    the key whose frequent values are split off. Rows of heavy keys are made distinct by a shuffle on all of
    ``identity``, which spreads each heavy key, and are then counted with map-side combining. For the rest a
    single shuffle on ``skew_key`` serves both steps.
    """
    skew_key = skew_key or keys[0]
    columns = list(dict.fromkeys([*keys, *identity]))
    rows = df.select(*columns)
    heavy = heavy_keys(rows, skew_key) if heavy is None else heavy
    counted = F.count(F.lit(1)).alias(count_name)

    def tail(part: DataFrame) -> DataFrame:
        return part.repartition(F.col(skew_key)).dropDuplicates(columns).groupBy(*keys).agg(counted)

    if not heavy:
        return tail(rows)
    hot, rest = split_heavy(rows, skew_key, heavy)
    return hot.dropDuplicates(columns).groupBy(*keys).agg(counted).unionByName(tail(rest))


def aggregate_skewed(
    df: DataFrame,
    keys: Sequence[str],
    partial: dict[str, Column],
    final: dict[str, Column],
    *,
    spread_by: Sequence[str],
    skew_key: str | None = None,
    heavy: Sequence | None = None,
    salts: int = 64,
) -> DataFrame:
    """Aggregates per key in two steps: ``partial`` per key and salt, then ``final`` over the partial columns.

    The salt of a row of a heavy key is a hash of ``spread_by``; rows equal in these columns meet in one
    salt, so a distinct count of them may be summed. Rows of other keys are aggregated on one shuffle.
    """
    skew_key = skew_key or keys[0]
    heavy = heavy_keys(df, skew_key) if heavy is None else heavy

    def both(part: DataFrame, salt: Column) -> DataFrame:
        name = fresh(part, "salt")
        first = part.withColumn(name, salt).groupBy(*keys, name).agg(*(c.alias(a) for a, c in partial.items()))
        return first.groupBy(*keys).agg(*(c.alias(a) for a, c in final.items()))

    def plain(part: DataFrame) -> DataFrame:
        once = part.repartition(F.col(skew_key)).groupBy(*keys).agg(*(c.alias(a) for a, c in partial.items()))
        return once.groupBy(*keys).agg(*(c.alias(a) for a, c in final.items()))

    if not heavy:
        return plain(df)
    hot, rest = split_heavy(df, skew_key, heavy)
    return both(hot, F.pmod(F.xxhash64(*spread_by), F.lit(salts))).unionByName(plain(rest))


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    key: str | Sequence[str],
    how: str = "left",
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Join ``big`` with a side unique in ``key`` (one column or several) whose size is not known beforehand.

    Up to ``broadcast_rows`` (counted first) the small side is broadcast. Beyond, rows of heavy values of the first key column of
    ``big`` meet the few rows of these values by broadcast and all others by a shuffle. ``how`` is left, inner, left_semi or
    left_anti.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if within(small, broadcast_rows):
        return big.join(F.broadcast(small), keys, how)
    heavy = heavy_keys(big, keys[0]) if heavy is None else heavy
    if not heavy:
        return big.join(small, keys, how)
    hot, rest = split_heavy(big, keys[0], heavy)
    few, _ = split_heavy(small, keys[0], heavy)
    return hot.join(F.broadcast(few), keys, how).unionByName(rest.join(small, keys, how))


def spread_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], spread_by: str, *, salts: int = 64, heavy: Sequence | None = None) -> DataFrame:
    """Inner join of two sides that both repeat keys. Pairs of a heavy key are made by ``salts`` tasks: its left rows are dealt out by a hash of
    ``spread_by``, and its right rows go to each. What is heavy is looked for on both sides, by the first key column.
    """
    keys = [key] if isinstance(key, str) else list(key)
    heavy = heavy_keys(left.select(keys[0]).unionByName(right.select(keys[0])), keys[0]) if heavy is None else heavy
    if not heavy:
        return left.join(right, keys)
    hot_l, rest_l = split_heavy(left, keys[0], heavy)
    hot_r, rest_r = split_heavy(right, keys[0], heavy)
    salt = fresh(left.select(*left.columns, *(F.lit(0).alias(c) for c in right.columns if c not in left.columns)), "salt")
    dealt = hot_l.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copied = hot_r.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rest_l.join(rest_r, keys).unionByName(dealt.join(copied, [*keys, salt]).drop(salt))


def running_totals(df: DataFrame, order: str, totals: dict[str, str]) -> DataFrame:
    """``df`` with running sums: for each ``name: column`` of ``totals`` the sum of the column over all rows up to each, in the order of the unique column ``order``.

    Ranges of the order are summed by themselves; a few numbers per range go to the driver and back. No task sees more than its range.
    """
    part = fresh(df, "part")
    rows = cut(df.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()))
    sums = rows.groupBy(part).agg(*(F.sum(c).alias(n) for n, c in totals.items())).orderBy(part).collect()
    up_to = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, column in totals.items():
        before, held = {}, 0
        for r in sums:
            before[r[part]] = held
            held += r[name] or 0
        offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col(part)) if before else F.lit(0)
        rows = rows.withColumn(name, F.sum(column).over(up_to) + offset)
    return rows.drop(part)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
