"""Command line: ``python -m tracewright.cli A B [options]``."""

from __future__ import annotations

import argparse
import sys

from tracewright.plans.pipeline import Config, Outputs, load_filter, load_ignore_file, run_pipeline
from tracewright.sources.srctree import DEFAULT_IGNORES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description="Compare two folders of source code or text.")
    p.add_argument("dir_a")
    p.add_argument("dir_b")
    p.add_argument("--mode", choices=("simple", "deep"), default="deep")
    for flag in ("by-word", "normalize-whitespace", "strip-comments", "squash-blanks", "collapse-identical", "detect-moved", "metrics-only", "normalize", "lang-aware", "no-autojunk", "per-side-grammar"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--threshold", type=float, default=60.0)
    p.add_argument("--threshold-deep", type=float)
    p.add_argument("--encoding", default="auto")
    p.add_argument("--sort-by", choices=("filename", "path", "similarity", "ratio"))
    p.add_argument("--sort-order", choices=("asc", "desc"), default="asc")
    p.add_argument("--uncompared-files", choices=("inline", "separate", "none"), default="inline")
    p.add_argument("--binary-handling", choices=("exclude", "hash", "error"), default="hash")
    p.add_argument("--ignore-file")
    p.add_argument("--default-ignores", action="store_true", help="leave out build output, caches and editor folders, besides what --ignore-file names")
    p.add_argument("--filter-json")
    p.add_argument("--unreadable-log")
    p.add_argument("--max-file-size", type=float, default=10.0)
    p.add_argument("--max-diff-html-size", type=float, default=2.0)
    p.add_argument("--dir-alias-a")
    p.add_argument("--dir-alias-b")
    p.add_argument("--k-gram", type=int, default=5)
    p.add_argument("--window", type=int, default=4)
    p.add_argument("--max-index-entries", type=int)
    p.add_argument("--report-json")
    p.add_argument("--report-md")
    p.add_argument("--report-html")
    p.add_argument("--html-folder")
    p.add_argument("--tables")
    p.add_argument("--exhibits")
    p.add_argument("--hash", dest="manifest", metavar="MANIFEST")
    p.add_argument("--bundle")
    p.add_argument("--preserve-tree", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--bates-number", action="store_true")
    p.add_argument("--bates-prefix", default="")
    p.add_argument("--bates-suffix", default="")
    p.add_argument("--bates-start", type=int, default=1)
    p.add_argument("--workers", type=int, default=4, help="threads of a local session")
    return p


def settings(args: argparse.Namespace) -> tuple[Config, Outputs]:
    same = ("mode", "by_word", "normalize_whitespace", "strip_comments", "squash_blanks", "threshold", "sort_by", "sort_order", "collapse_identical", "detect_moved", "uncompared_files", "binary_handling", "metrics_only")
    same += ("max_file_size", "max_diff_html_size", "dir_alias_a", "dir_alias_b", "k_gram", "window", "threshold_deep", "normalize", "lang_aware", "max_index_entries", "per_side_grammar")
    if args.workers < 1 or args.bates_start < 1:
        raise ValueError("workers and Bates numbers start at 1")
    config = Config(
        **{name: getattr(args, name) for name in same},
        encoding=None if args.encoding == "auto" else args.encoding,
        autojunk=not args.no_autojunk,
        ignore=(load_ignore_file(args.ignore_file) if args.ignore_file else ()) + (DEFAULT_IGNORES if args.default_ignores else ()),
        filter_paths=load_filter(args.filter_json) if args.filter_json else None,
    )
    outputs = Outputs(
        json=args.report_json,
        markdown=args.report_md,
        html=args.report_html,
        html_folder=args.html_folder,
        tables=args.tables,
        exhibits=args.exhibits,
        manifest=args.manifest,
        bundle=args.bundle,
        unreadable_log=args.unreadable_log,
        preserve_tree=args.preserve_tree,
        bates_prefix=args.bates_prefix,
        bates_suffix=args.bates_suffix,
        bates_start=args.bates_start if args.bates_number else None,
    )
    return config, outputs


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        config, outputs = settings(args)
    except ValueError as e:
        print(f"tracewright: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{args.workers}]").appName("tracewright").getOrCreate()
    summary = run_pipeline(spark, args.dir_a, args.dir_b, config, outputs)["report"]["summary"]
    print(", ".join(f"{k}: {v}" for k, v in summary.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
