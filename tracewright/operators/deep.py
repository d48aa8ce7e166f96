"""Many-to-many comparison: which files of B share fingerprints with each file of A, and how much."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.fingerprints import K, W, fingerprints
from tracewright.functions.tokens import token_channel, tokens
from tracewright.operators import postings
from tracewright.operators.skew import lookup_join, running_totals, spread_join
from tracewright.session import cut

THRESHOLD = 0.05
#: Threshold in per cent of flattened fingerprints, and the tokens below which such a match is inconclusive.
NORMALIZE_THRESHOLD, INCONCLUSIVE_TOKENS = 93.0, 45


def fingerprint_sets(docs: DataFrame, doc: str, text: str, *, k: int = K, w: int = W, normalize: bool = False, extension: Column | None = None, lang_aware: bool = False) -> DataFrame:
    """``doc, fps array<struct<h, pos>>, n_tokens, n_fp``; ``n_tokens`` counts raw tokens in the flattened channel and is -1 in the raw one."""
    channel = token_channel(F.col(text), normalize=normalize, extension=extension, lang_aware=lang_aware)
    count = F.size(tokens(F.col(text))).cast("long") if normalize else F.lit(-1).cast("long")
    rows = docs.select(F.col(doc).alias("doc"), fingerprints(channel, k, w).alias("fps"), count.alias("n_tokens"))
    return rows.withColumn("n_fp", F.size("fps").cast("long"))


def hash_sets(sets: DataFrame) -> DataFrame:
    """``doc, n_tokens, n_fp, hs`` of ``fingerprint_sets``: the distinct hashes in order, a fourth of the bytes with positions; enough for all that is in this file."""
    return sets.select("doc", "n_tokens", "n_fp", F.array_sort(F.array_distinct(F.transform("fps", lambda f: f["h"]))).alias("hs"))


#: Threshold from which candidates come from the rarest hashes alone.
PREFIX_FROM = 0.3


def _sides(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """``doc_x, t_x, n_x, hs`` of both sides: distinct hashes with their number."""
    out = []
    for side, s in ((a, "a"), (b, "b")):
        own = side if "hs" in side.columns else hash_sets(side.withColumn("n_fp", F.size("fps").cast("long")))
        hashes = own.select(F.col("doc").alias(f"doc_{s}"), F.col("n_tokens").alias(f"t_{s}"), "hs", F.col("n_fp").alias(f"n_fp_{s}"))
        out.append(hashes.withColumn(f"n_{s}", F.size("hs").cast("long")).where(F.col(f"n_{s}") > 0))
    return out


def _capped(side: DataFrame, entries: int) -> DataFrame:
    """Hashes of the first documents, as many as an index of this size holds; sizes stay those of the whole sets. Only sizes are summed up in order."""
    before = running_totals(side.select("doc_b", "n_b"), "doc_b", {"total": "n_b"}).select("doc_b", (F.col("total") - F.col("n_b")).alias("before"))
    kept = side.join(before.where(F.col("before") < entries), "doc_b")
    room = F.greatest(F.lit(0), F.least(F.col("n_b"), F.lit(entries) - F.col("before"))).cast("int")
    return kept.withColumn("hs", F.slice(F.array_sort("hs"), F.lit(1), room)).drop("before")


def _counted(left: DataFrame, right: DataFrame, bound: Column) -> DataFrame:
    """Shared hashes of all pairs that share one: the inverted index as a join that spreads frequent hashes, counted with partial aggregation."""
    a = left.select("doc_a", "t_a", "n_a", F.explode("hs").alias("h"))
    keys = ["doc_a", "doc_b", "n_a", "n_b", "t_a", "t_b"]
    return spread_join(a, right, "h", "doc_a").where(bound).groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"))


def _by_prefix(left: DataFrame, right: DataFrame, bound: Column, threshold: float) -> DataFrame:
    """The same pairs at or above a high threshold, without the frequent hashes.

    With hashes ordered from the rarest on, two sets at Jaccard t share one of the first n - ceil(t n) + 1 of each. Only these meet;
    the candidates are counted exactly.
    """
    every = left.select(F.explode("hs").alias("h")).unionByName(right.select(F.explode("hs").alias("h")))
    often = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("df")))

    def prefix(side: DataFrame, s: str) -> DataFrame:
        rows = lookup_join(side.select(f"doc_{s}", f"n_{s}", F.explode("hs").alias("h")), often, "h", "inner")
        ordered = rows.groupBy(f"doc_{s}", f"n_{s}").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
        keep = (F.col(f"n_{s}") - F.ceil(F.col(f"n_{s}") * F.lit(threshold) * F.lit(1 - 1e-9)) + 1).cast("int")
        return ordered.select(f"doc_{s}", f"n_{s}", F.explode(F.slice("o", F.lit(1), keep)).alias("x")).select(f"doc_{s}", f"n_{s}", "x.h")

    pairs = spread_join(cut(prefix(left, "a")), cut(prefix(right, "b")), "h", "doc_a").where(bound).select("doc_a", "doc_b").distinct()
    full = pairs.join(left, "doc_a").withColumnRenamed("hs", "hs_a").join(right, "doc_b")
    return full.select("doc_a", "doc_b", "n_a", "n_b", "t_a", "t_b", F.size(F.array_intersect("hs_a", "hs")).cast("long").alias("shared"))


def matches_by_file(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD, *, normalize: bool = False, max_index_entries: int | None = None) -> DataFrame:
    """``doc_a, n_fp, found`` of A documents with a match: array of ``doc_b, shared, jaccard, inconclusive``, by Jaccard, shared hashes, then the B document.

    Sides come from ``fingerprint_sets``; one row per document. Pairs are never shuffled: each task counts whole A documents against an index of B in
    the shared folder (``postings``). Nothing is truncated unless ``max_index_entries`` says so; see ``index_truncated``. Documents without fingerprints match nothing.
    """
    left, right = _sides(a, b)
    prefix, few = threshold >= PREFIX_FROM, INCONCLUSIVE_TOKENS if normalize else None
    folder = postings.local_folder(a.sparkSession)
    if folder is None:
        return _by_joins(left, right, threshold, few, max_index_entries)
    rows, entries = _rows(left, right, max_index_entries)
    path = postings.build(rows[1], entries[1], folder)
    return postings.matches(rows[0], entries[0], path, threshold, prefix=prefix, few_tokens=few, doc_b=b.schema["doc"].dataType.simpleString())


def _rows(left: DataFrame, right: DataFrame, max_index_entries: int | None) -> tuple[list[DataFrame], list[int]]:
    """``doc, n_fp, tokens, n, hs`` of both sides, as ``postings`` takes them, and the number of values."""
    index = right if max_index_entries is None else _capped(right, max_index_entries)
    rows = []
    for side, s in ((left, "a"), (index, "b")):
        rows.append(side.select(F.col(f"doc_{s}").alias("doc"), F.col(f"n_fp_{s}").alias("n_fp"), F.col(f"t_{s}").alias("tokens"), F.col(f"n_{s}").alias("n"), F.array_sort("hs").alias("hs")))
    return rows, [side.agg(F.sum(F.size("hs"))).first()[0] or 0 for side in rows]


def _segments(rows: list[DataFrame], entries: list[int], folder: str) -> tuple[list[str], tuple[int, int]]:
    """Folders of both sides for ``postings.pairs`` and the number of their segments."""
    path_b, n_b = postings.build_even(rows[1], postings.SEGMENT_ENTRIES, folder, inverted=True)
    tasks_a = math.ceil(2 * rows[0].sparkSession.sparkContext.defaultParallelism / max(1, n_b))
    path_a, n_a = postings.build_even(rows[0], max(1, min(postings.TASK_ENTRIES, math.ceil(entries[0] / tasks_a))), folder, inverted=False)
    return [path_a, path_b], (n_a, n_b)


def _by_joins(left: DataFrame, right: DataFrame, threshold: float, few_tokens: int | None, max_index_entries: int | None) -> DataFrame:
    """``matches_by_file`` where the shared folder is no mounted one: the pairs are shuffled."""
    bound = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") * F.lit(1 - 1e-9)
    if threshold >= PREFIX_FROM and max_index_entries is None:
        shared = _by_prefix(left, right, bound, threshold)
    else:
        index = right if max_index_entries is None else _capped(right, max_index_entries)
        shared = _counted(left, index.select("doc_b", "t_b", "n_b", F.explode("hs").alias("h")), bound)
    fewest = F.least("t_a", "t_b")
    inconclusive = (fewest >= 0) & (fewest < few_tokens) if few_tokens is not None else F.lit(False)
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    scored = shared.select("doc_a", "doc_b", "shared", jaccard.alias("jaccard"), inconclusive.alias("inconclusive")).where(F.col("jaccard") >= threshold)
    item = F.struct((-F.col("jaccard")).alias("j"), (-F.col("shared")).alias("s"), "doc_b", "shared", "jaccard", "inconclusive")
    grouped = scored.groupBy("doc_a").agg(F.array_sort(F.collect_list(item)).alias("found")).join(left.select("doc_a", F.col("n_fp_a").alias("n_fp")), "doc_a")
    return grouped.select("doc_a", "n_fp", F.transform("found", lambda m: m.dropFields("j", "s")).alias("found"))


def deep_matches(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD, *, normalize: bool = False, max_index_entries: int | None = None) -> DataFrame:
    """``doc_a, doc_b, shared, jaccard, inconclusive`` of pairs at or above the (unrounded) threshold.

    Each task counts a segment of A against one of B, so its rows hold few different names: the result takes a fifth of the disk of rows that mix all of B.
    """
    spark, few = a.sparkSession, INCONCLUSIVE_TOKENS if normalize else None
    folder = postings.local_folder(spark)
    left, right = _sides(a, b)
    if folder is None:
        return _by_joins(left, right, threshold, few, max_index_entries).select("doc_a", F.inline("found"))
    rows, entries = _rows(left, right, max_index_entries)
    paths, segments = _segments(rows, entries, folder)
    kinds = tuple(side.schema["doc"].dataType.simpleString() for side in (a, b))
    return postings.pairs(*paths, segments, spark, threshold, prefix=threshold >= PREFIX_FROM, few_tokens=few, kinds=kinds)


def deep_ranked(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_a, match_rank, doc_b, jaccard`` of the same pairs, in the order of ``ranked`` with the rounded Jaccard; nothing is shuffled, sorted or stored for the ranks."""
    left, right = _sides(a, b)
    folder = postings.local_folder(a.sparkSession)
    if folder is None:
        found = report_order(matches_by_file(a, b, threshold)).select("doc_a", F.posexplode("found").alias("at", "m"))
        return found.select("doc_a", (F.col("at") + 1).cast("long").alias("match_rank"), "m.doc_b", (-F.col("m.j")).alias("jaccard"))
    paths, segments = _segments(*_rows(left, right, None), folder)
    kinds = tuple(side.schema["doc"].dataType.simpleString() for side in (a, b))
    return postings.ranks(*paths, segments, a.sparkSession, threshold, prefix=threshold >= PREFIX_FROM, kinds=kinds)


def index_truncated(b: DataFrame, max_index_entries: int) -> bool:
    """Whether an index of B with this cap would be cut short (or filled exactly)."""
    entries = b.select(F.explode(F.array_distinct(F.transform("fps", lambda f: f["h"]))).alias("h"))
    return entries.limit(max_index_entries).count() >= max_index_entries


def ranked(matches: DataFrame, top: int | None = None) -> DataFrame:
    """Matches with ``match_rank`` within each A file: rounded Jaccard, shared hashes, then the B file."""
    order = Window.partitionBy("doc_a").orderBy(F.desc(F.round("jaccard", 4)), F.desc("shared"), "doc_b")
    out = matches.withColumn("match_rank", F.row_number().over(order))
    return out.where(F.col("match_rank") <= top) if top else out


def report_order(found: DataFrame) -> DataFrame:
    """``doc_a, n_fp, found`` of ``matches_by_file`` in the order of ``ranked``: array of ``j, s, doc_b, inconclusive`` with the negative of the rounded Jaccard and
    of the shared hashes. Sorted within each row; nothing is shuffled.
    """
    item = F.transform("found", lambda m: F.struct((-F.round(m["jaccard"], 4)).alias("j"), (-m["shared"]).alias("s"), m["doc_b"].alias("doc_b"), m["inconclusive"].alias("inconclusive")))
    return found.withColumn("found", F.array_sort(item))


def nested_by_file(found: DataFrame) -> DataFrame:
    """One row per A file of ``matches_by_file`` with its matches best first, as reports want it."""
    item = lambda m: F.struct(m["doc_b"].alias("file_b"), (-m["s"]).alias("shared_hashes"), (-m["j"]).alias("jaccard"), m["inconclusive"].alias("inconclusive"))
    return report_order(found).select(F.col("doc_a").alias("file_a"), F.col("n_fp").alias("fingerprint_count_a"), F.transform("found", item).alias("matches"))


def nested(matches: DataFrame, sides_a: DataFrame) -> DataFrame:
    """One row per A file with its matches best first, as reports want it."""
    item = F.struct("match_rank", F.col("doc_b").alias("file_b"), F.col("shared").alias("shared_hashes"), F.round("jaccard", 4).alias("jaccard"), "inconclusive")
    grouped = ranked(matches).groupBy("doc_a").agg(F.array_sort(F.collect_list(item)).alias("matches"))
    return grouped.join(sides_a.select(F.col("doc").alias("doc_a"), "n_fp"), "doc_a").select(
        F.col("doc_a").alias("file_a"), F.col("n_fp").alias("fingerprint_count_a"), F.transform("matches", lambda m: m.dropFields("match_rank")).alias("matches")
    )
