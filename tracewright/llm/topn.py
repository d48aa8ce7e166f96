"""The N best items of every group, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import fresh

SALTS = 32


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    item: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    salts: int = SALTS,
    rank_name: str | None = None,
) -> DataFrame:
    """Rows of ``df`` that are among the first ``n`` distinct items of their group in ``order``.

    Two-stage salted ranking: a hash of ``item`` puts the rows of a group into ``salts`` subgroups; each keeps
    one row per item (its first in ``order``) and of these the first ``n``; the at most ``salts * n``
    survivors of a group are then ranked again. Both steps of the first stage share one shuffle, and a window
    limit drops rows before each. Null groups and null items are values like any other (filter them out
    beforehand if they do not count). Ties in ``order`` are settled by ``item``; of repeated rows one stays; an empty input
    or ``n < 1`` gives no rows. Other columns pass through; ``rank_name``, if given, adds the rank.
    """
    if n < 1:
        out = df.where(F.lit(False))
        return out.withColumn(rank_name, F.lit(None).cast("int")) if rank_name else out
    salt, rank = fresh(df, "salt"), fresh(df, "rank")
    whole = [*order, *(F.col(c).asc_nulls_last() for c in item)]
    rows = df.withColumn(salt, F.pmod(F.xxhash64(*item), F.lit(salts))).repartition(*group, salt)
    once = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group, salt, *item).orderBy(*whole))).where(F.col(rank) == 1)
    part = once.withColumn(rank, F.row_number().over(Window.partitionBy(*group, salt).orderBy(*whole))).where(F.col(rank) <= n)
    last = part.drop(salt).withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*whole))).where(F.col(rank) <= n)
    return last.withColumnRenamed(rank, rank_name) if rank_name else last.drop(rank)
