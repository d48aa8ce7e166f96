"""A whole comparison of two folders: scan, match, difference, deep comparison, reports and evidence."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import __version__
from tracewright.functions.comments import clean
from tracewright.functions.text import normalize_ws, split_lines, squash_blank_lines, suffix, wrap_cjk
from tracewright.operators import deep, diffs, evidence, matching
from tracewright.session import cut, spread
from tracewright.sinks import reports
from tracewright.sources.srctree import decoded, load_ignores, read_tree


@dataclass(frozen=True)
class Config:
    """Options of a comparison; the command line sets the same."""

    mode: str = "deep"
    by_word: bool = False
    normalize_whitespace: bool = False
    strip_comments: bool = False
    squash_blanks: bool = False
    threshold: float = 60.0
    encoding: str | None = None
    sort_by: str | None = None
    sort_order: str = "asc"
    collapse_identical: bool = False
    detect_moved: bool = False
    uncompared_files: str = "inline"
    binary_handling: str = "hash"
    ignore: tuple[str, ...] = ()
    metrics_only: bool = False
    filter_paths: tuple[str, ...] | None = None
    max_file_size: float = 10.0
    max_diff_html_size: float = 2.0
    dir_alias_a: str | None = None
    dir_alias_b: str | None = None
    k_gram: int = 5
    window: int = 4
    threshold_deep: float | None = None
    normalize: bool = False
    lang_aware: bool = False
    autojunk: bool = True
    max_index_entries: int | None = None
    per_side_grammar: bool = False

    def __post_init__(self) -> None:
        checks = (
            (self.mode in ("simple", "deep"), "mode is simple or deep"),
            (0 <= self.threshold <= 100 and 0 <= (self.threshold_deep or 0) <= 100, "thresholds lie in 0..100"),
            (self.k_gram >= 1 and self.window >= 1, "k-gram and window are at least 1"),
            (self.max_index_entries is None or self.max_index_entries >= 1, "the index holds at least 1 entry"),
            (self.sort_by in (None, *reports.SORTS) and self.sort_order in ("asc", "desc"), "unknown order"),
            (self.uncompared_files in ("inline", "separate", "none"), "uncompared files are inline, separate or none"),
            (self.binary_handling in ("exclude", "hash", "error"), "binary handling is exclude, hash or error"),
            (self.max_file_size > 0 and self.max_diff_html_size > 0, "sizes are positive"),
        )
        for good, message in checks:
            if not good:
                raise ValueError(message)

    @property
    def deep_threshold(self) -> tuple[float, str]:
        """Per cent and where it comes from: user, default or normalize-default."""
        if self.threshold_deep is not None:
            return self.threshold_deep, "user"
        return (deep.NORMALIZE_THRESHOLD, "normalize-default") if self.normalize else (100 * deep.THRESHOLD, "default")


DENIED = "Access Denied (PermissionError)"


def compare_pairs(matches: DataFrame, a: DataFrame, b: DataFrame, config: Config) -> DataFrame:
    """``matches`` with ratio, additions, deletions, html, error, binary, hash_match of each pair.

    Sides have ``rel_path, length, content, error``. Files above the size cap and binary files are compared by digest. The texts
    meet in one join per side; everything else happens in the row.
    """
    cap = int(config.max_file_size * (1 << 20))
    left = a.select(F.col("rel_path").alias("rel_path_a"), F.col("length").alias("len_a"), F.col("content").alias("bytes_a"), F.col("error").alias("err_a"))
    right = b.select(F.col("rel_path").alias("rel_path_b"), F.col("length").alias("len_b"), F.col("content").alias("bytes_b"), F.col("error").alias("err_b"))
    both = spread(matches.join(left, "rel_path_a").join(right, "rel_path_b"))
    failed = F.coalesce("err_a", "err_b")
    large = failed.isNull() & (F.greatest("len_a", "len_b") > cap)
    small = F.when(failed.isNull() & ~large, F.lit(True))
    read = both.withColumns({"text_a": decoded(F.when(small, F.col("bytes_a")), config.encoding), "text_b": decoded(F.when(small, F.col("bytes_b")), config.encoding)})
    unread = small & (F.col("text_a").isNull() | F.col("text_b").isNull())
    read = read.withColumn("equal", F.sha2("bytes_a", 256) == F.sha2("bytes_b", 256)).withColumn("by_hash", F.coalesce(large | unread, F.lit(False)))
    if config.strip_comments:
        ext_a = suffix(F.col("rel_path_a"))
        ext_b = suffix(F.col("rel_path_b")) if config.per_side_grammar else ext_a
        for text, ext in (("text_a", ext_a), ("text_b", ext_b)):
            cleaned = clean(F.col(text), ext)
            read = read.withColumn(text, squash_blank_lines(cleaned) if config.squash_blanks else cleaned)
    options = {"autojunk": config.autojunk, "normalize_ws": config.normalize_whitespace}
    kept = read.withColumn("d", diffs.diff_column(F.col("text_a"), F.col("text_b"), by_word=config.by_word, **options))
    unreadable = F.col("by_hash") & (F.greatest("len_a", "len_b") <= cap)
    if config.binary_handling == "exclude":
        kept = kept.where(~unreadable)
    as_error = failed.isNotNull() | (unreadable if config.binary_handling == "error" else F.lit(False))
    by_hash = F.col("by_hash") & ~as_error
    value = lambda name, other: F.when(as_error, F.lit(0)).when(by_hash, F.lit(other)).otherwise(F.col(f"d.{name}"))
    shown = F.lit(None).cast("string")
    if not config.metrics_only:
        kept = with_lines(kept.withColumn("shown", ~F.col("by_hash") & failed.isNull()), config)
        shown = reports.html_column(
            F.col("lines_a"), F.col("lines_b"), F.col("ops"), F.col("moves"), cap_bytes=int(config.max_diff_html_size * (1 << 20)), context=3 if config.collapse_identical else -1
        )
        shown = wrap_cjk(shown)
    return kept.select(
        *matches.columns,
        F.when(as_error, F.lit(0.0)).when(by_hash, F.col("equal").cast("double")).otherwise(F.col("d.ratio")).alias("ratio"),
        value("additions", 0).cast("long").alias("additions"),
        value("deletions", 0).cast("long").alias("deletions"),
        shown.alias("html"),
        F.when(failed.isNotNull(), failed).when(as_error, F.lit("binary file")).alias("error"),
        F.coalesce(by_hash, F.lit(False)).alias("binary"),
        F.when(by_hash, F.col("equal")).alias("hash_match"),
    )


def with_lines(pairs: DataFrame, config: Config) -> DataFrame:
    """``pairs`` with ``lines_a, lines_b, ops, moves`` of those to be ``shown``: what a page of differences needs.

    The line opcodes are those of the metrics, unless these are of words; a view of words shows tabs as blanks, and its lines are matched here.
    """
    options = {"autojunk": config.autojunk, "normalize_ws": config.normalize_whitespace}
    texts = {}
    for side in "ab":
        text = F.replace(f"text_{side}", F.lit("\t"), F.lit(" ")) if config.by_word else F.col(f"text_{side}")
        texts[side] = F.when(F.col("shown"), text)
    ops = diffs.diff_column(texts["a"], texts["b"], **options)["opcodes"] if config.by_word else F.col("d.opcodes")
    lines = {s: split_lines(normalize_ws(t) if config.normalize_whitespace else t) for s, t in texts.items()}
    pairs = pairs.withColumns({"lines_a": lines["a"], "lines_b": lines["b"], "ops": F.when(F.col("shown"), ops)})
    if not config.detect_moved:
        return pairs.withColumn("moves", F.lit(None).cast("array<struct<a_lines:array<int>,b_lines:array<int>>>"))
    pairs = cut(pairs.drop("bytes_a", "bytes_b"))  # one matching of sequences serves metrics, page and moves
    moved = diffs.moved_blocks(pairs, "rel_path_a", "lines_a", "lines_b", "ops")
    return pairs.join(moved.groupBy("rel_path_a").agg(F.collect_list(F.struct("a_lines", "b_lines")).alias("moves")), "rel_path_a", "left")


def compare_deep(a: DataFrame, b: DataFrame, config: Config) -> tuple[DataFrame, bool]:
    """Deep matches, one row per A file; comments are always stripped by each file's own grammar, files above the size cap are left out."""
    cap = int(config.max_file_size * (1 << 20))

    def sets(side: DataFrame) -> DataFrame:
        text = spread(side.where((F.col("length") <= cap) & F.col("content").isNotNull())).select("rel_path", decoded(F.col("content")).alias("text"))
        cleaned = text.where("text is not null").select("rel_path", clean(F.col("text"), suffix(F.col("rel_path"))).alias("text"))
        return cut(deep.fingerprint_sets(cleaned, "rel_path", "text", k=config.k_gram, w=config.window, normalize=config.normalize, extension=suffix(F.col("rel_path")), lang_aware=config.lang_aware))

    fp_a, fp_b = sets(a), sets(b)
    truncated = config.max_index_entries is not None and deep.index_truncated(fp_b, config.max_index_entries)
    found = deep.matches_by_file(fp_a, fp_b, config.deep_threshold[0] / 100, normalize=config.normalize, max_index_entries=config.max_index_entries)
    return deep.nested_by_file(found), truncated


def compare(spark: SparkSession, dir_a: str, dir_b: str, config: Config = Config()) -> dict:
    """All results as DataFrames, with metadata; see ``tracewright.sinks`` for reports."""
    tree = {"a": read_tree(spark, dir_a, config.ignore), "b": read_tree(spark, dir_b, config.ignore)}
    tree = {s: cut(df) for s, df in tree.items()}
    # a file that cannot be read still has its place among the pairs; what is no file does not
    files = {s: df.where(F.col("error").isNull() | (F.col("error") == DENIED)) for s, df in tree.items()}
    matches, left_a, left_b = matching.match_files(files["a"], files["b"], config.threshold)
    if config.filter_paths is not None:
        listed = spark.createDataFrame([(p,) for p in config.filter_paths], "rel_path string")
        matches = matching.keep_listed(matches, listed)
        left_a, left_b = left_a.join(listed.distinct(), "rel_path", "left_semi"), left_b.limit(0)
    results = cut(compare_pairs(reports.match_order(matches), files["a"], files["b"], config))
    deep_results, truncated = (None, False) if config.mode == "simple" else compare_deep(files["a"], files["b"], config)
    threshold, provenance = config.deep_threshold
    return {
        "config": config,
        "metadata": {
            "exec_mode": config.mode,
            "k": config.k_gram,
            "w": config.window,
            "threshold": threshold,
            "threshold_provenance": provenance,
            "autojunk": config.autojunk,
            "normalize": config.normalize,
            "lang_aware": config.lang_aware,
            "deep_index_truncated": truncated,
        },
        "label_a": config.dir_alias_a or Path(dir_a).name,
        "label_b": config.dir_alias_b or Path(dir_b).name,
        "files": files,
        "skipped": {s: df.where("error is not null").select("rel_path", "error") for s, df in tree.items()},
        "results": reports.sort_results(results, config.sort_by, config.sort_order),
        "deep": deep_results,
        "unmatched_a": left_a,
        "unmatched_b": left_b,
    }


@dataclass(frozen=True)
class Outputs:
    """Where reports go; what is None is not written."""

    json: str | None = None
    markdown: str | None = None
    html: str | None = None
    html_folder: str | None = None
    tables: str | None = None
    exhibits: str | None = None
    manifest: str | None = None
    bundle: str | None = None
    unreadable_log: str | None = None
    preserve_tree: bool = True
    bates_prefix: str = ""
    bates_suffix: str = ""
    bates_start: int | None = None


def run_pipeline(spark: SparkSession, dir_a: str, dir_b: str, config: Config = Config(), outputs: Outputs = Outputs()) -> dict:
    """Compare and write what ``outputs`` names; returns the run with ``report`` and the list ``written``."""
    if outputs.bates_start is not None and outputs.bates_start < 1:
        raise ValueError("Bates numbers start at 1 or later")
    if config.metrics_only and (outputs.html or outputs.html_folder):
        config = replace(config, metrics_only=False)
    run = compare(spark, dir_a, dir_b, config)
    # the report holds every pair on the driver: it is built for those who ask for one to read, with pages only where these go into it
    wanted = outputs.json or outputs.markdown or outputs.html or outputs.html_folder
    run["report"] = report = reports.report_dict(run, pages=bool(outputs.json or outputs.html)) if wanted else None
    written: list[Path] = []
    hashes = {s: evidence.hash_entries(run["files"][s]) for s in "ab"}
    if outputs.json:
        written.append(reports.write_json(report, Path(outputs.json)))
    if outputs.markdown:
        Path(outputs.markdown).write_text(reports.markdown(report), encoding="utf-8")
        written.append(Path(outputs.markdown))
    if outputs.html:
        table = {s: [r.asDict() for r in df.orderBy("rel_path").toLocalIterator()] for s, df in hashes.items()}
        page = reports.write_html(report, Path(outputs.html), table)
        written += [page, evidence.write_signature(page)]
    if outputs.html_folder:
        written.append(reports.write_html_pages(run["results"], report, Path(outputs.html_folder), outputs.preserve_tree))
    if outputs.exhibits:
        pages = F.greatest(F.lit(1), F.ceil((F.col("additions") + F.col("deletions")) / 60))
        index = reports.exhibit_index(run["results"], pages, bates_prefix=outputs.bates_prefix, bates_suffix=outputs.bates_suffix, bates_start=outputs.bates_start)
        written.append(reports.write_exhibits(index, Path(outputs.exhibits)))
    if outputs.tables:
        reports.write_tables(run, outputs.tables)
    if config.uncompared_files == "separate" and outputs.json:
        names = [f"{s.upper()}: {r['rel_path']}" for s in "ab" for r in run[f"unmatched_{s}"].orderBy("rel_path").toLocalIterator()]
        written.append(reports.write_lines(names, Path(outputs.json).with_name(Path(outputs.json).stem + "_uncompared.txt")))
    if outputs.unreadable_log:
        rows = {f"{r['rel_path']}: {r['error']}" for s in "ab" for r in run["skipped"][s].toLocalIterator()}
        written.append(reports.write_lines(sorted(rows), Path(outputs.unreadable_log)))
    if outputs.manifest or outputs.bundle:
        record = evidence.manifest(hashes["a"], hashes["b"], run["label_a"], run["label_b"], written, __version__)
        if outputs.manifest:
            Path(outputs.manifest).write_text(json.dumps(record, ensure_ascii=False, indent=2), encoding="utf-8")
        if outputs.bundle:
            evidence.write_bundle(Path(outputs.bundle), run["files"], record, written)
    run["written"] = written
    return run


def load_filter(path: str) -> tuple[str, ...]:
    return tuple(json.loads(Path(path).read_text(encoding="utf-8")))


def load_ignore_file(path: str) -> tuple[str, ...]:
    return tuple(load_ignores(Path(path).read_text(encoding="utf-8")))
