import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.cli import main, parser, settings
from tracewright.operators.disclosure import normalize_disclosure
from tracewright.plans.pipeline import Config, Outputs, compare, run_pipeline
from tracewright.sources.srctree import decode_bytes, ignored, read_tree, should_ignore

CODE = "".join(f"def f{i}(x):\n    # step {i}\n    return x * {i} + y{i % 7}\n" for i in range(40))


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    files = {
        "left/pkg/__init__.py": "",
        "left/.env": "A=1\n",
        "left/pkg/_priv/q.py": CODE,
        "left/old/util.py": "a\nb\nc\n",
        "left/blob.bin": b"\x00\xff\xfe\x01" * 50,
        "left/only_left.txt": "alone\n",
        "left/node_modules/d.js": "x",
        "left/계산기.py": "값 = 1\n",
        "right/pkg/__init__.py": "",
        "right/pkg/_priv/q.py": CODE.replace("y3", "z3"),
        "right/new/util.py": "a\nb\nd\n",
        "right/blob.bin": b"\x00\xff\xfe\x01" * 50,
        "right/계산기.py": "값 = 1\n",
        "right/copy/moved_name_entirely.py": CODE,
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    os.symlink(root / "left/pkg/__init__.py", root / "left/pkg/link.py")
    return root


def test_tree_source(spark, trees):
    rows = read_tree(spark, str(trees / "left"), ["node_modules"]).collect()
    assert {r.rel_path for r in rows if r.error is None} == {"pkg/__init__.py", ".env", "pkg/_priv/q.py", "old/util.py", "blob.bin", "only_left.txt", "계산기.py"}
    assert [(r.rel_path, r.error) for r in rows if r.error] == [("pkg/link.py", "symbolic link")]
    assert [r.length for r in rows if r.rel_path == "pkg/__init__.py"] == [0]


def test_ignore_patterns(spark):
    assert should_ignore("pkg/node_modules", ["node_modules"]) and should_ignore("src/generated/x.py", ["src/generated"])
    assert should_ignore("build/a.gen.cs", ["**/*.gen.cs"]) and not should_ignore("main.cs", ["**/*.gen.cs"])
    assert not should_ignore("src/x.py", ["", "# note"])
    df = spark.createDataFrame([("pkg/node_modules/dep.py",), ("src/generated/x.py",), ("build/a.gen.cs",), ("main.cs",)], "p string")
    kept = df.where(~ignored(F.col("p"), ["node_modules", "src/generated", "**/*.gen.cs"]))
    assert [r.p for r in kept.collect()] == ["main.cs"]


def test_decode():
    assert decode_bytes(b"") == "" and decode_bytes(None) is None
    assert decode_bytes("값".encode()) == "값" and decode_bytes("값".encode("cp949"), "cp949") == "값"
    assert decode_bytes(b"\xff\xfe\x00\x01", "utf-8") is None


def test_run_with_all_reports(spark, trees, tmp_path):
    config = Config(ignore=("node_modules",), collapse_identical=True, detect_moved=True, uncompared_files="separate", sort_by="path")
    out = Outputs(json=str(tmp_path / "r.json"), markdown=str(tmp_path / "r.md"), html=str(tmp_path / "r.html"), html_folder=str(tmp_path / "pages"), exhibits=str(tmp_path / "x.csv"), manifest=str(tmp_path / "m.json"), bundle=str(tmp_path / "b.zip"), unreadable_log=str(tmp_path / "u.log"), tables=str(tmp_path / "t"), bates_prefix="EX-", bates_start=7)
    run = run_pipeline(spark, str(trees / "left"), str(trees / "right"), config, out)
    report = json.loads((tmp_path / "r.json").read_text())
    by = {r["file_a"]: r for r in report["results"]}
    assert by["pkg/__init__.py"]["ratio"] == 1.0 and by["old/util.py"]["file_b"] == "new/util.py"
    assert (by["old/util.py"]["additions"], by["old/util.py"]["deletions"]) == (1, 1)
    assert by["blob.bin"]["binary"] and by["blob.bin"]["hash_match"] and by["blob.bin"]["ratio"] == 1.0
    assert report["unmatched_a"] == [] and report["summary"]["unmatched_a_count"] == 2
    deep = {d["file_a"]: d["matches"] for d in report["deep_results"]}
    assert [m["file_b"] for m in deep["pkg/_priv/q.py"]] == ["copy/moved_name_entirely.py", "pkg/_priv/q.py"]
    assert "word-del" in (tmp_path / "r.html").read_text() and (tmp_path / "r.html.sig").exists()
    assert (tmp_path / "pages/index.html").exists() and (tmp_path / "pages/pkg/_priv/q.py.html").exists()
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf") and "EX-0007" in (tmp_path / "x.csv").read_text("utf-8-sig")
    assert (tmp_path / "r_uncompared.txt").read_text() == "A: .env\nA: only_left.txt\nB: copy/moved_name_entirely.py\n"
    assert (tmp_path / "u.log").read_text() == "pkg/link.py: symbolic link\n"
    manifest = json.loads((tmp_path / "m.json").read_text())
    assert manifest["source_a"]["root"] == "left" and manifest["source_a"]["file_count"] == 7
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert {"a/blob.bin", "b/new/util.py", "manifest.json", "reports/r.json"} <= set(z.namelist())
    assert spark.read.parquet(str(tmp_path / "t/results")).count() == len(report["results"]) == run["report"]["summary"]["matched_pairs"]


def test_options(spark, trees):
    left, right = str(trees / "left"), str(trees / "right")
    ignore = ("node_modules",)
    one = compare(spark, left, right, Config(mode="simple", ignore=ignore, filter_paths=("pkg/_priv/q.py",), metrics_only=True, strip_comments=True))
    rows = one["results"].collect()
    assert [r.rel_path_a for r in rows] == ["pkg/_priv/q.py"] and rows[0].html is None and one["deep"] is None
    assert one["unmatched_b"].count() == 0
    small = compare(spark, left, right, Config(mode="simple", ignore=ignore, max_file_size=1e-6))
    got = {r.rel_path_a: (r.binary, r.ratio) for r in small["results"].collect()}
    assert got["pkg/_priv/q.py"] == (True, 0.0) and got["계산기.py"] == (True, 1.0)
    excluded = compare(spark, left, right, Config(mode="simple", ignore=ignore, binary_handling="exclude"))
    assert "blob.bin" not in {r.rel_path_a for r in excluded["results"].collect()}
    failed = compare(spark, left, right, Config(mode="simple", ignore=ignore, binary_handling="error"))
    assert {r.rel_path_a: r.error for r in failed["results"].collect()}["blob.bin"] == "binary file"
    flat = compare(spark, left, right, Config(ignore=ignore, normalize=True, lang_aware=True))
    assert flat["metadata"]["threshold"] == 93.0 and flat["metadata"]["threshold_provenance"] == "normalize-default"
    assert "pkg/_priv/q.py" in {r.file_a for r in flat["deep"].collect()}


def test_validation_and_disclosure():
    for bad in ({"k_gram": 0}, {"window": 0}, {"threshold": 101}, {"mode": "x"}, {"sort_by": "x"}, {"binary_handling": "x"}, {"max_index_entries": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert main(["a", "b", "--k-gram", "0"]) == 2 and main(["a", "b", "--bates-start", "0"]) == 2
    config, outputs = settings(parser().parse_args(["a", "b", "--no-autojunk", "--bates-number", "--normalize"]))
    assert not config.autojunk and outputs.bates_start == 1 and config.deep_threshold == (93.0, "normalize-default")
    assert "does not apply" in normalize_disclosure(50, "user") and "0.95%" in normalize_disclosure(93, "user")
