"""Inverted index of sets in the shared folder, and the counting of shared values against it without a shuffle of pairs.

The index consists of segments, ranges of the right side's documents of about ``SEGMENT_ENTRIES`` values each, that tasks map into memory. A task reads
whole sets of the left side and knows all pairs of each before it gives out a row. So pairs are neither shuffled nor
written before they are results, and are in order within each left document. Where all pairs are the result (``pairs``), both sides are
segments and a task counts one against one: it gives out few different names, which column formats then store once.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.skew import running_totals
from tracewright.session import shared_dir

#: Values of a segment, about; and of the left side per task, about.
SEGMENT_ENTRIES, TASK_ENTRIES = 4_000_000, 400_000
#: Bytes of a segment's names where all pairs are given out, so that Parquet's dictionary of 1 MiB (with 4 bytes a name) holds them.
NAME_BYTES = 950_000
#: Pairs of a batch that leaves a task (a document's pairs stay together), values gathered at once, and pairs that a task remembers for equal sets.
BATCH_PAIRS, GATHERED, MEMO_PAIRS = 200_000, 2_000_000, 2_000_000
FIELDS = ("hashes", "starts", "posts", "own_starts", "own", "sizes", "doc_starts", "docs", "tokens")


#: What only the side that is looked up needs.
INVERTED = ("starts", "posts")


def local_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that every worker can map, or None if it is no mounted folder."""
    folder = shared_dir(spark)
    if folder.startswith("file:"):
        return "/" + folder[len("file:") :].lstrip("/")
    return None if "://" in folder else os.path.abspath(folder)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array of lists."""
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def _segment(table: pa.Table) -> dict[str, np.ndarray]:
    """Arrays of a segment from rows ``doc, tokens, n, hs`` in order; documents of equal sets are one class."""
    values, at = _lists(table["hs"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64())))
    whole = table["n"].to_numpy()
    classes: dict[tuple[int, bytes], int] = {}
    of = np.empty(table.num_rows, np.int64)
    first: list[int] = []
    for i in range(table.num_rows):
        key = (int(whole[i]), values[at[i] : at[i + 1]].tobytes())
        c = classes.get(key)
        if c is None:
            c = classes[key] = len(first)
            first.append(i)
        of[i] = c
    held = [values[at[i] : at[i + 1]] for i in first]
    lengths = np.array([len(x) for x in held], np.int64)
    flat = np.concatenate([*held, np.empty(0, np.int64)])
    hashes, own = np.unique(flat, return_inverse=True)
    order = np.argsort(own, kind="stable")
    docs = np.argsort(of, kind="stable")
    return {
        "hashes": hashes,
        "starts": np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(hashes)))]).astype(np.int64),
        "posts": np.repeat(np.arange(len(first), dtype=np.int32), lengths)[order],
        "own_starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "own": own.astype(np.int32),
        "sizes": whole[first].astype(np.int64) if first else np.empty(0, np.int64),
        "doc_starts": np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))]).astype(np.int64),
        "docs": docs.astype(np.int64),
        "tokens": table["tokens"].to_numpy().astype(np.int64),
    }


def _write(table: pa.Table, path: str, number: int, inverted: bool = True) -> None:
    spot = os.path.join(path, f"{number:06d}")
    part = f"{spot}.{uuid.uuid4().hex}"
    os.makedirs(part)
    for name, values in _segment(table).items():
        if inverted or name not in INVERTED:
            np.save(os.path.join(part, f"{name}.npy"), values)
    with pa.OSFile(os.path.join(part, "names.arrow"), "wb") as out, pa.ipc.new_file(out, table.select(["doc"]).schema) as writer:
        writer.write_table(table.select(["doc"]).combine_chunks())
    try:
        os.rename(part, spot)
    except OSError:  # another attempt of the task was first
        shutil.rmtree(part)


def _new_folder(folder: str) -> str:
    path = os.path.join(folder, f"postings-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def build(side: DataFrame, entries: int, folder: str) -> str:
    """Index of ``doc, tokens, n, hs`` (sets in order of their values, ``n`` their whole sizes); the folder that holds it."""
    path = _new_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches:
            _write(pa.Table.from_batches(batches), path, TaskContext.get().partitionId())
            yield pa.record_batch([pa.array([1])], names=["done"])

    rows = side.repartitionByRange(max(1, math.ceil(entries / SEGMENT_ENTRIES)), "doc").sortWithinPartitions("doc")
    rows.select("doc", "tokens", "n", "hs").mapInArrow(run, "done bigint").count()
    return path


def build_even(side: DataFrame, entries: int, folder: str, *, inverted: bool) -> tuple[str, int]:
    """Like ``build``, in segments of ``entries`` values and ``NAME_BYTES`` of names and one document more at most; the folder and their number.

    Only names and sizes are summed up in order; the driver gets the first name of each segment.
    """
    path, unit = _new_folder(folder), 1_000_000_000
    load = F.ceil(F.greatest(F.size("hs") / F.lit(entries), (F.octet_length(F.col("doc").cast("string")) + 4) / F.lit(NAME_BYTES)) * F.lit(unit)).cast("long")
    total = running_totals(side.select("doc", load.alias("load")), "doc", {"total": "load"})
    of = lambda c: F.floor((c - 1) / F.lit(unit))
    first = total.withColumn("s", of(F.col("total"))).groupBy("s").agg(F.min("doc").alias("doc")).orderBy("doc").collect()
    starts = F.array(*(F.lit(r["doc"]) for r in first[1:])) if first[1:] else None
    number = F.lit(0) if starts is None else F.size(F.filter(starts, lambda x: x <= F.col("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and numbers[x] != at:
                    _write(pa.Table.from_batches(held), path, at, inverted)
                    held = []
                at = int(numbers[x])
                held.append(batch.slice(x, y - x))
        if held:
            _write(pa.Table.from_batches(held), path, at, inverted)
        yield pa.record_batch([pa.array([1])], names=["done"])

    rows = side.select("doc", "tokens", "n", "hs", number.cast("long").alias("number")).repartition(max(1, len(first)), "number").sortWithinPartitions("number", "doc")
    rows.mapInArrow(run, "done bigint").count()
    return path, len(first)


class Index:
    """The segments of a folder, in order of their documents."""

    def __init__(self, path: str):
        spots = sorted(x for x in os.listdir(path) if "." not in x)
        self.segments = [{f: np.load(os.path.join(path, x, f"{f}.npy"), mmap_mode="r") for f in FIELDS} for x in spots]
        names = [pa.ipc.open_file(pa.memory_map(os.path.join(path, x, "names.arrow"))).read_all()["doc"] for x in spots]
        self.names = pa.chunked_array([c for x in names for c in x.chunks], names[0].type) if names else None
        if self.names is not None and self.names.num_chunks == 1:
            self.names = self.names.chunk(0)
        self.tokens = np.concatenate([*(s["tokens"] for s in self.segments), np.empty(0, np.int64)])
        self.offsets = np.cumsum([0, *(len(s["docs"]) for s in self.segments)])

    def matches(self, h: np.ndarray, n: int, threshold: float, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that share a value of ``h`` (whole size ``n``) and reach the threshold, the best first: number, shared values, Jaccard."""
        return _best_first([(offset, s, *_reaching(s, h, n, threshold, prefix)) for s, offset in zip(self.segments, self.offsets, strict=False)])


def _reaching(s: dict[str, np.ndarray], h: np.ndarray, n: int, threshold: float, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a segment at or above the threshold, shared values, Jaccard."""
    classes, shared = _shared(s, h, n, threshold, prefix)
    jaccard = shared / (n + s["sizes"][classes] - shared)
    keep = jaccard >= threshold
    return classes[keep], shared[keep], jaccard[keep]


def _best_first(segments: list[tuple[int, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of classes of segments (number of their first document, segment, classes, shared, Jaccard), the best first."""
    found = []
    for offset, s, classes, shared, jaccard in segments:
        starts = s["doc_starts"][classes]
        copies = s["doc_starts"][classes + 1] - starts
        found.append((s["docs"][_spans(starts, copies)] + offset, np.repeat(shared, copies), np.repeat(jaccard, copies)))
    docs, shared, jaccard = (np.concatenate([*x]) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.lexsort((docs, -shared, -jaccard))
    return docs[order], shared[order], jaccard[order]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - before, lengths)


def _shared(s: dict[str, np.ndarray], h: np.ndarray, n: int, threshold: float, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a segment that share a value with ``h`` and may reach the threshold, and how many they share.

    Two sets at Jaccard t share t n values of a set of n or more, so one of any n - ceil(t n) + 1 of them. With ``prefix`` only the classes of
    this many values, the rarest of the segment, are counted, by their own values.
    """
    at = np.searchsorted(s["hashes"], h)
    h, at = h[at < len(s["hashes"])], at[at < len(s["hashes"])]
    at = at[s["hashes"][at] == h]
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = s["starts"][at], s["starts"][at + 1]
    if prefix:
        least = math.ceil(threshold * n * (1 - 1e-9))
        if len(at) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rarest = np.argsort(ends - starts, kind="stable")[: len(at) - least + 1]
        met = np.unique(s["posts"][_spans(starts[rarest], (ends - starts)[rarest])]).astype(np.int64)
        sizes = s["sizes"][met]
        met = met[np.minimum(sizes, n) >= threshold * np.maximum(sizes, n) * (1 - 1e-9)]
        own = s["own_starts"][met]
        lengths = s["own_starts"][met + 1] - own
        if int(lengths.sum()) < int((ends - starts).sum()):
            shared = np.zeros(len(met), np.int64)
            mark = np.zeros(len(s["hashes"]), bool)
            mark[at] = True
            for a, b in _chunks(lengths):
                hit = np.concatenate([[0], np.cumsum(mark[s["own"][_spans(own[a:b], lengths[a:b])]])])
                until = np.cumsum(lengths[a:b])
                shared[a:b] = hit[until] - hit[until - lengths[a:b]]
            return met, shared
    counts = np.zeros(len(s["sizes"]), np.int64)
    for a, b in _chunks(ends - starts):
        counts += np.bincount(np.concatenate([s["posts"][x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]), minlength=len(counts))
    met = np.flatnonzero(counts)
    return met, counts[met]


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``GATHERED`` values."""
    total, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + GATHERED, "right")))
        yield a, b
        a = b


@lru_cache(maxsize=1)
def _index(path: str) -> Index:
    return Index(path)


@lru_cache(maxsize=2)
def _one(path: str, number: int) -> tuple[dict[str, np.ndarray], pa.Array]:
    """A segment and its names; no other is opened."""
    spot = os.path.join(path, f"{number:06d}")
    names = pa.ipc.open_file(pa.memory_map(os.path.join(spot, "names.arrow"))).read_all()["doc"].combine_chunks()
    return {f: np.load(at, mmap_mode="r") for f in FIELDS if os.path.exists(at := os.path.join(spot, f"{f}.npy"))}, names.chunk(0) if isinstance(names, pa.ChunkedArray) else names


def pairs(left: str, right: str, segments: tuple[int, int], spark: SparkSession, threshold: float, *, prefix: bool, few_tokens: int | None, kinds: tuple[str, str]) -> DataFrame:
    """``doc_a, doc_b, shared, jaccard, inconclusive`` of all pairs at or above the threshold, from two folders of ``build_even``; a task has a segment of each.

    The pairs of a document with a segment are together, the best first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (x for batch in batches for x in batch.column("id").to_pylist()):
            (a, names_a), (b, names_b) = _one(left, task // segments[1]), _one(right, task % segments[1])

            def found(h: np.ndarray, n: int, b=b) -> tuple[np.ndarray, ...]:
                return _best_first([(0, b, *_reaching(b, h, n, threshold, prefix))])

            for at, docs, shared, jaccard in _by_class(a, found):
                fewest = np.minimum(a["tokens"][at], b["tokens"][docs])
                doubt = (fewest >= 0) & (fewest < few_tokens) if few_tokens is not None else np.zeros(len(docs), bool)
                columns = [names_a.take(pa.array(at)), names_b.take(pa.array(docs)), pa.array(shared), pa.array(jaccard), pa.array(doubt)]
                yield pa.record_batch(columns, names=["doc_a", "doc_b", "shared", "jaccard", "inconclusive"])

    return _tasks(spark, segments).mapInArrow(run, f"doc_a {kinds[0]}, doc_b {kinds[1]}, shared bigint, jaccard double, inconclusive boolean")


def ranks(left: str, right: str, segments: tuple[int, int], spark: SparkSession, threshold: float, *, prefix: bool, kinds: tuple[str, str]) -> DataFrame:
    """``doc_a, match_rank, doc_b, jaccard`` of the same pairs: Jaccard rounded to four digits, and the place by it, shared values and the right document.

    A task gives out the pairs of a segment of each side. How many pairs of the other right segments come before, it counts again by class, so nothing is stored
    or shuffled for the places; counting takes as many times as there are right segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _index(right).segments
        for task in (x for batch in batches for x in batch.column("id").to_pylist()):
            j = task % segments[1]
            (a, names_a), names_b = _one(left, task // segments[1]), _one(right, j)[1]

            def found(h: np.ndarray, n: int, j=j) -> tuple[np.ndarray, ...]:
                own = _order_keys(every[j], h, n, threshold, prefix)
                if not len(own[0]):
                    return (np.empty(0, np.int64),) * 3
                starts = every[j]["doc_starts"][own[0]]
                copies = every[j]["doc_starts"][own[0] + 1] - starts
                docs, key, tenth = every[j]["docs"][_spans(starts, copies)], np.repeat(own[1], copies), np.repeat(own[2], copies)
                order = np.lexsort((docs, key))
                docs, key, tenth = docs[order], key[order], tenth[order]
                place = np.arange(1, len(docs) + 1)
                for k, s in enumerate(every):
                    if k != j:  # equal keys of earlier segments come before, as their documents do
                        classes, other, _ = _order_keys(s, h, n, threshold, prefix)
                        sorting = np.argsort(other)
                        before = np.concatenate([[0], np.cumsum((s["doc_starts"][classes + 1] - s["doc_starts"][classes])[sorting])])
                        place += before[np.searchsorted(other[sorting], key, "right" if k < j else "left")]
                return docs, place, tenth

            for at, docs, place, tenth in _by_class(a, found):
                columns = [names_a.take(pa.array(at)), pa.array(place), names_b.take(pa.array(docs)), pa.array(tenth / 10_000)]
                yield pa.record_batch(columns, names=["doc_a", "match_rank", "doc_b", "jaccard"])

    return _tasks(spark, segments).mapInArrow(run, f"doc_a {kinds[0]}, match_rank bigint, doc_b {kinds[1]}, jaccard double")


def _order_keys(s: dict[str, np.ndarray], h: np.ndarray, n: int, threshold: float, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a segment at or above the threshold, a key that is the less the better they match, and ten thousand times the Jaccard, half up."""
    classes, shared, _ = _reaching(s, h, n, threshold, prefix)
    union = n + s["sizes"][classes] - shared
    tenth = (20_000 * shared + union) // (2 * union)
    return classes, -((tenth << 40) + shared), tenth


def _tasks(spark: SparkSession, segments: tuple[int, int]) -> DataFrame:
    """``id`` of each segment against each, one a task."""
    many = segments[0] * segments[1]
    return spark.range(0, many, 1, 1).repartition(max(1, many))


def _by_class(a: dict[str, np.ndarray], found: Callable[[np.ndarray, int], tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents of a segment beside each of what is ``found`` for their sets, in batches; equal sets are looked for once."""
    parts: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for c in range(len(a["sizes"])):
        rows = found(a["hashes"][a["own"][a["own_starts"][c] : a["own_starts"][c + 1]]], int(a["sizes"][c]))
        for doc in a["docs"][a["doc_starts"][c] : a["doc_starts"][c + 1]]:
            for x in range(0, len(rows[0]), BATCH_PAIRS):
                part = [r[x : x + BATCH_PAIRS] for r in rows]
                parts.append((np.full(len(part[0]), doc), *part))
                waiting += len(part[0])
                if waiting >= BATCH_PAIRS:
                    yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                    parts, waiting = [], 0
    if parts:
        yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def matches(side: DataFrame, entries: int, path: str, threshold: float, *, prefix: bool, few_tokens: int | None, doc_b: str) -> DataFrame:
    """``doc_a, n_fp, found`` of the rows ``doc, n_fp, tokens, n, hs`` with a match: array of ``doc_b, shared, jaccard, inconclusive``, the best first.

    A match is inconclusive if one of its documents has fewer than ``few_tokens`` tokens.
    """
    kind = side.schema["doc"].dataType.simpleString()
    item = f"struct<doc_b:{doc_b},shared:bigint,jaccard:double,inconclusive:boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(path)
        memo: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held = 0
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            values, at = _lists(columns["hs"])
            sizes, tokens = columns["n"].to_numpy(), columns["tokens"].to_numpy()
            rows: list[int] = []
            parts: list[tuple] = []
            pairs = 0

            def out(columns=columns, tokens=tokens, rows=rows, parts=parts) -> pa.RecordBatch:
                docs, shared, jaccard = (np.concatenate([p[i] for p in parts]) for i in range(3))
                lengths = [len(p[0]) for p in parts]
                fewest = np.minimum(index.tokens[docs], np.repeat(tokens[rows], lengths))
                names = index.names.take(pa.array(docs))
                names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
                doubt = (fewest >= 0) & (fewest < few_tokens) if few_tokens is not None else np.zeros(len(docs), bool)
                items = pa.StructArray.from_arrays([names, pa.array(shared), pa.array(jaccard), pa.array(doubt)], ["doc_b", "shared", "jaccard", "inconclusive"])
                found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), items)
                picked = pa.array(rows)
                ready = pa.record_batch([columns["doc"].take(picked), columns["n_fp"].take(picked), found], names=["doc_a", "n_fp", "found"])
                rows.clear()
                parts.clear()
                return ready

            for i in range(batch.num_rows):
                h = values[at[i] : at[i + 1]]
                key = (int(sizes[i]), h.tobytes())
                found = memo.get(key)
                if found is None:
                    found = index.matches(h, key[0], threshold, prefix)
                    held += len(found[0]) + 1
                    if held > MEMO_PAIRS:
                        memo.clear()
                        held = len(found[0]) + 1
                    memo[key] = found
                if len(found[0]):
                    rows.append(i)
                    parts.append(found)
                    pairs += len(found[0])
                    if pairs >= BATCH_PAIRS:
                        yield out()
                        pairs = 0
            if rows:
                yield out()

    tasks = max(2 * side.sparkSession.sparkContext.defaultParallelism, math.ceil(entries / TASK_ENTRIES))
    return side.select("doc", "n_fp", "tokens", "n", "hs").repartition(tasks, "doc").mapInArrow(run, f"doc_a {kind}, n_fp bigint, found array<{item}>")
