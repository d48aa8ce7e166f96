"""Long exact spans shared between records, by content-defined chunking.

A record is a sequence of 64-bit values. A gear rolling hash cuts it into variable chunks where the hash of the last
``GEAR_REACH`` values meets a mask, so a cut depends on the values around it only and survives insertions
elsewhere. Chunks are deduplicated by a 128-bit digest; a chunk whose digest occurs in one record only cannot lie in a
shared span. A window of ``span`` values that holds a chunk (or holds none: then it is its own chunk) is verified by
its own 128-bit digest if all its chunks are shared. Two equal windows have the same chunks, so no shared window is missed.

No pair of records is ever formed: digests are grouped with map-side combining, and a group of copies of any
size costs its rows once. A record of any length is split into segments of bounded size that overlap by a halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join
from tracewright.session import cut

#: Low bits of the gear hash that a cut looks at: it depends on as many last values.
GEAR_REACH = 3
#: Of these bits, those that must be zero: one cut in four positions.
GEAR_MASK = 0b110
#: Entries of a segment; longer records are split.
SEGMENT = 32_768
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(values: np.ndarray) -> np.ndarray:
    """Whether a chunk ends at each value, decided by it and the values before it within the reach."""
    gear = _mix(values.view(np.uint64), 0x5EED)
    h = gear.copy()
    for back in range(1, GEAR_REACH):
        h[back:] += gear[:-back] << np.uint64(back)
    end = (h & np.uint64(GEAR_MASK)) == 0
    end[: GEAR_REACH - 1] = False  # too near the start to be decided by content alone
    return end


def _running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _mix(values.view(np.uint64), 1), _mix(values.view(np.uint64), 2)


def span_digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of ``values[start:end]`` for each pair, of their length too."""
    out = []
    lengths = (ends - starts).astype(np.int64)
    for mixed, c in zip(_running(values), (_C1, _C2), strict=True):
        total = lengths.astype(np.uint64) * c
        left = lengths.copy()
        at = starts.copy()
        # spans are short: one vector step per value of the longest
        alive = np.arange(len(starts))
        while len(alive):
            alive = alive[left[alive] > 0]
            total[alive] = (total[alive] ^ mixed[at[alive]]) * c + (total[alive] >> np.uint64(29))
            at[alive] += 1
            left[alive] -= 1
        out.append(_mix(total, 3).view(np.int64))
    return out[0], out[1]


def chunk_spans(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what is looked up: chunks no longer than ``span``, and windows that hold no such chunk whole.

    A chunk runs from one cut (not included, but for the values that decide it) to the next.
    """
    n = len(values)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.flatnonzero(cuts(values)) + 1
    # the values that decide the first cut belong to the chunk, so that its content decides that it is one
    start = end[:-1] - GEAR_REACH
    stop = end[1:]
    fits = stop - start <= span
    start, stop = start[fits], stop[fits]
    windows = np.arange(n - span + 1)
    first = np.searchsorted(start, windows)  # first chunk that starts in the window
    whole = np.zeros(len(windows), bool)
    has = first < len(start)
    whole[has] = stop[first[has]] <= windows[has] + span
    alone = windows[~whole]
    return np.concatenate([start, alone]), np.concatenate([stop, alone + span])


def candidate_windows(n: int, start: np.ndarray, stop: np.ndarray, shared: np.ndarray, span: int) -> np.ndarray:
    """Starts of windows all of whose chunks are shared."""
    if n < span:
        return np.empty(0, np.int64)
    bad = np.zeros(n - span + 2, np.int64)
    low, high = np.maximum(stop[~shared] - span, 0), np.minimum(start[~shared], n - span)
    ok = low <= high
    np.add.at(bad, low[ok], 1)
    np.add.at(bad, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(bad[:-1]) == 0)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(record, segment), kind, pos and value arrays of each group's distinct rows, from sorted rows; a group may span batches."""
    key, held = None, []

    def distinct():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return (c[new] for c in columns)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rec, seg, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("record", "segment", "kind", "pos", "value"))
        edge = np.flatnonzero((rec[1:] != rec[:-1]) | (seg[1:] != seg[:-1])) + 1
        for a, b in zip([0, *edge], [*edge, n], strict=True):
            k = (rec[a], int(seg[a]))
            if k != key:
                if key is not None:
                    yield key, *distinct()
                key, held = k, []
            held.append([c[a:b] for c in rest])
    if key is not None:
        yield key, *distinct()


def _emit(schema: pa.Schema, rows: Iterator[tuple], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches from one tuple per group: the record, the segment, then arrays of one length."""
    held, n = [], 0

    def batch():
        counts = [len(r[2]) for r in held]
        records = pa.array([r[0] for r in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        columns = [records, np.repeat([r[1] for r in held], counts), *(np.concatenate(c) for c in zip(*(r[2:] for r in held), strict=True))]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for parts in rows:
        if len(parts[2]):
            held.append(parts)
            n += len(parts[2])
        if n >= size:
            yield batch()
            held, n = [], 0
    if n:
        yield batch()


def segments(entries: DataFrame, span: int, segment: int = SEGMENT) -> DataFrame:
    """``record, segment, kind, pos, value``: each record's ``record, pos, value`` rows in segments that overlap.

    ``kind`` is 0. Records that may be longer than a segment (by their largest position) are numbered in
    two steps, per block of positions and by the sizes of the blocks before; others in their one segment. Segment s
    holds the entries from ``s * segment`` on and a halo of the next segment's first ``span + reach`` entries.
    """
    long_ones = cut(entries.groupBy("record").agg(F.max("pos").alias("top"), F.min("pos").alias("low")).where((F.col("top") - F.col("low")) >= segment).select("record"))
    plain = [F.lit(0).alias("kind"), "pos", "value"]
    if long_ones.isEmpty():
        return entries.select("record", F.lit(0).cast("long").alias("segment"), *plain)
    marked = lookup_join(entries, long_ones.withColumn("is_long", F.lit(True)), "record", "left")
    short = marked.where("is_long is null").select("record", F.lit(0).cast("long").alias("segment"), *plain)
    block = F.floor(F.col("pos") / F.lit(segment)).cast("long")
    rows = cut(marked.where("is_long").select("record", "pos", "value", block.alias("block")).distinct())
    sizes = rows.groupBy("record", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("record").orderBy("block")) - F.col("n")).drop("n")
    inside = Window.partitionBy("record", "block").orderBy("pos", "value")
    numbered = rows.join(before, ["record", "block"]).withColumn("at", F.col("base") + F.row_number().over(inside) - 1)
    own = F.floor(F.col("at") / F.lit(segment)).cast("long")
    halo = (F.pmod(F.col("at"), F.lit(segment)) < F.lit(span + GEAR_REACH)) & (own > 0)
    placed = F.explode(F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))).alias("segment")
    return short.unionByName(cut(numbered.select("record", placed, *plain)))


_HEAD = [("record", pa.string()), ("segment", pa.int64())]


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with each segment together and in order, by one shuffle. Repeated rows are neighbours then; ``_grouped`` drops them.

    No aggregate stands between the shuffle and the sort: the planner may shuffle for one again, by other keys.
    """
    columns = ["record", "segment", "kind", "pos", "value"]
    return rows.select(*columns).repartition("record", "segment").sortWithinPartitions(*columns)


def _chunks(rows: DataFrame, span: int) -> DataFrame:
    """``record, segment, start, stop, d1, d2`` of every span that is looked up."""
    schema = pa.schema([*_HEAD, ("start", pa.int32()), ("stop", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        def groups():
            for (rec, seg), _, _, values in _grouped(batches):
                start, stop = chunk_spans(values, span)
                yield rec, seg, start, stop, *span_digests(values, start, stop)

        yield from _emit(schema, groups())

    return _sorted(rows).mapInArrow(run, "record string, segment bigint, start int, stop int, d1 bigint, d2 bigint")


def _windows(rows: DataFrame, hits: DataFrame, span: int, segment: int) -> DataFrame:
    """``record, segment, at, first, last, d1, d2`` of each window all of whose chunks are in ``hits``; ``at`` counts the record's entries."""
    schema = pa.schema(
        [*_HEAD, ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]
    )

    def run(batches):
        def groups():
            for (rec, seg), kind, pos, values in _grouped(batches):
                hit = kind == 1
                if not hit.any() or hit.all():
                    continue
                shared = set(zip(pos[hit].tolist(), values[hit].tolist(), strict=True))
                pos, values = pos[~hit], values[~hit]
                start, stop = chunk_spans(values, span)
                known = np.fromiter((x in shared for x in zip(start.tolist(), stop.tolist(), strict=True)), bool, len(start))
                at = candidate_windows(len(values), start, stop, known, span)
                at = at[at < segment]
                yield rec, seg, at + seg * segment, pos[at], pos[at + span - 1], *span_digests(values, at, at + span)

        yield from _emit(schema, groups())

    marked = hits.select("record", "segment", F.lit(1).alias("kind"), F.col("start").cast("long").alias("pos"), F.col("stop").cast("long").alias("value"))
    return _sorted(rows.unionByName(marked)).mapInArrow(
        run, "record string, segment bigint, at bigint, first bigint, last bigint, d1 bigint, d2 bigint"
    )


def _shared(digests: DataFrame) -> DataFrame:
    """Digests that occur in two records or more. A digest held by any number of rows is combined before it is shuffled."""
    return digests.groupBy("d1", "d2").agg(F.min("record").alias("a"), F.max("record").alias("b")).where("a <> b").select("d1", "d2")


def _islands(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Join runs of ``at .. to`` (window starts) whose entries touch, within ``keys``."""
    order = Window.partitionBy(*keys).orderBy("at")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("at") > reach + span), 1).otherwise(0)
    numbered = rows.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    merged = numbered.groupBy(*keys, "island").agg(
        F.min("at").alias("at"), F.max("to").alias("to"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return merged.drop("island")


def shared_spans(
    entries: DataFrame, record: str, position: str, value: str, *, span: int = 20, only: DataFrame | None = None, segment: int = SEGMENT
) -> DataFrame:
    """Maximal runs of shared entries: ``record, start_position, end_position, n_entries``.

    Rows with a null record, position or value are left out and repeated ones count once; a record is the sequence of its
    values by position (ties by value). An entry is shared if it lies in ``span`` consecutive entries that another record
    holds too, in the same order. ``only``, if given, holds the records (one column) whose runs are wanted; all
    records are compared with in any case. No entries, or records shorter than ``span``, give no rows.
    """
    tidy = entries.where(F.col(record).isNotNull() & F.col(position).isNotNull() & F.col(value).isNotNull()).select(
        F.col(record).alias("record"), F.col(position).cast("long").alias("pos"), F.col(value).cast("long").alias("value")
    )
    rows = segments(tidy, span, segment)
    chunks = cut(_chunks(rows, span))
    hits = lookup_join(chunks, cut(_shared(chunks)), ["d1", "d2"], "left_semi").select("record", "segment", "start", "stop")
    windows = cut(_windows(rows, hits, span, segment))
    wanted = windows
    if only is not None:
        wanted = lookup_join(windows, only.toDF("record").where("record is not null").distinct(), "record", "left_semi")
    found = lookup_join(wanted, cut(_shared(windows)), ["d1", "d2"], "left_semi").select(
        "record", F.floor(F.col("at") / F.lit(segment)).alias("part"), "at", F.col("at").alias("to"), "first", "last"
    )
    # runs within parts of bounded length first, so that no record is gathered before it is reduced
    runs = _islands(_islands(found, ["record", "part"], span), ["record"], span)
    return runs.select(
        "record", F.col("first").cast("int").alias("start_position"), F.col("last").cast("int").alias("end_position"), (F.col("to") - F.col("at") + span).alias("n_entries")
    )
