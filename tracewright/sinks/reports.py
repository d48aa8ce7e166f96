"""Reports: JSON, Markdown, HTML (one page or one per pair), CSV of exhibits, lists and logs.

Large results belong into tables (``write_tables``); the documents for people stream through the driver row by row.
"""

from __future__ import annotations

import csv
import difflib
import html
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import md_escape, natural_key
from tracewright.operators.disclosure import normalize_disclosure
from tracewright.operators.skew import running_totals

STYLE = "table{border-collapse:collapse;font:12px monospace}td{padding:0 6px;vertical-align:top;white-space:pre-wrap}.delete{background:#fdd}.insert{background:#dfd}.replace{background:#ffd}.moved{background:#ddf}.fold{color:#888}.word-del{background:#f99}.word-add{background:#9f9}.cjk{font-family:sans-serif}"
SORTS = ("filename", "path", "similarity", "ratio")


def sort_results(results: DataFrame, by: str | None, order: str = "asc") -> DataFrame:
    """Results in report order; ``ord`` keeps the order of matching, and equal keys stay in it."""
    keys = {"filename": lambda: natural_key(F.element_at(F.split("rel_path_a", "/"), -1)), "path": lambda: natural_key(F.col("rel_path_a")), "similarity": lambda: F.col("similarity"), "ratio": lambda: F.col("ratio")}
    if by is None:
        return results.orderBy("ord")
    key = keys[by]()
    return results.orderBy(key.desc() if order == "desc" else key.asc(), "ord")


def match_order(matches: DataFrame) -> DataFrame:
    """``ord``: exact matches by path, then the others from the most similar on."""
    exact = (F.col("rel_path_a") == F.col("rel_path_b")).cast("int")
    return matches.withColumn("ord", F.struct((1 - exact).alias("late"), (F.when(exact == 1, 0.0).otherwise(-F.col("similarity"))).alias("score"), "rel_path_a", "rel_path_b"))


def _cells(text: str | None, other: str | None, tag: str, kind: str) -> str:
    if text is None:
        return ""
    if tag != "replace" or other is None:
        return html.escape(text)
    a, b = (text.split(" "), other.split(" ")) if kind == "del" else (other.split(" "), text.split(" "))
    out = []
    for code, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, False).get_opcodes():
        words = html.escape(" ".join(a[i1:i2] if kind == "del" else b[j1:j2]))
        if words:
            out.append(words if code == "equal" else f'<span class="word-{kind}">{words}</span>')
    return " ".join(out)


def html_diff(x: list[str], y: list[str], codes: list, moves: list = (), *, context: int = -1) -> str:
    """Table of two lists of lines, from their opcodes: line numbers and lines, marked words in replaced lines, folded equal spans, moved lines."""
    moved_a = {i for m in moves for i in m["a_lines"]}
    moved_b = {j for m in moves for j in m["b_lines"]}
    rows = []
    for op in codes:
        tag, i1, i2, j1, j2 = (op[c] for c in ("tag", "i1", "i2", "j1", "j2"))
        n = max(i2 - i1, j2 - j1)
        folds = tag == "equal" and context >= 0 and n > 2 * context
        for k in range(n):
            if folds and context <= k < n - context:
                if k == context:
                    rows.append(f'<tr class="fold"><td colspan="4">{n - 2 * context} equal lines</td></tr>')
                continue
            i, j = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
            ta, tb = (x[i] if i is not None else None), (y[j] if j is not None else None)
            mark = " moved" if i in moved_a or j in moved_b else ""
            rows.append(
                f'<tr class="{tag}{mark}"><td>{"" if i is None else i + 1}</td><td>{_cells(ta, tb, tag, "del")}</td>'
                f'<td>{"" if j is None else j + 1}</td><td>{_cells(tb, ta, tag, "add")}</td></tr>'
            )
    return f"<table>{''.join(rows)}</table>"


def html_column(lines_a: Column, lines_b: Column, opcodes: Column, moves: Column | None = None, *, cap_bytes: int = 2 << 20, context: int = -1) -> Column:
    """HTML of each pair from lines and opcodes, so that no sequence is matched again; a warning instead where it would be larger than ``cap_bytes``.

    A pair without opcodes has no HTML. ``moves`` holds structs with ``a_lines`` and ``b_lines``.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, codes, moved in batches:
            out = []
            for one in zip(x, y, codes, moved, strict=True):
                page = None if any(c is None for c in one[:3]) else html_diff(*one[:3], () if one[3] is None else one[3], context=context)
                if page is not None and len(page.encode()) > cap_bytes:
                    page = f"<p>The difference is larger than {cap_bytes / (1 << 20):g} MB and is not shown.</p>"
                out.append(page)
            yield pd.Series(out, dtype=object)

    none = F.lit(None).cast("array<struct<a_lines:array<int>,b_lines:array<int>>>")
    return of(lines_a, lines_b, opcodes, none if moves is None else moves)


def report_dict(run: dict, pages: bool = True) -> dict:
    """The JSON report, from a run's metadata, results (with their columns), deep results and residues: the form for people, one entry per pair.

    Without ``pages`` the HTML of the pairs stays where it is. For results of any size there are tables (``write_tables``).
    """
    meta, config = run["metadata"], run["config"]
    results = []
    found = run["results"] if pages else run["results"].drop("html")
    for r in found.toLocalIterator():
        entry = {"file_a": r["rel_path_a"], "file_b": r["rel_path_b"], "name_similarity": r["similarity"], "ratio": r["ratio"], "additions": r["additions"], "deletions": r["deletions"]}
        entry |= {"html_diff": r["html"] or "" if "html" in r else "", "error": r["error"], "binary": r["binary"]}
        if r["hash_match"] is not None:
            entry["hash_match"] = r["hash_match"]
        results.append(entry)
    deep = [r.asDict(recursive=True) for r in run["deep"].orderBy("file_a").toLocalIterator()] if run["deep"] is not None else []
    left = {s: [r["rel_path"] for r in run[f"unmatched_{s}"].orderBy("rel_path").toLocalIterator()] for s in "ab"}
    inline = config.uncompared_files == "inline"
    return {
        "metadata": meta,
        "dir_a": run["label_a"],
        "dir_b": run["label_b"],
        "comparison_unit": "word" if config.by_word else "line",
        "comment_mode": "stripped" if config.strip_comments else "included",
        "summary": {"matched_pairs": len(results), "unmatched_a_count": len(left["a"]), "unmatched_b_count": len(left["b"])},
        "results": results,
        "deep_results": deep,
        "unmatched_a": left["a"] if inline else [],
        "unmatched_b": left["b"] if inline else [],
    }


def write_json(report: dict, out: Path) -> Path:
    out.write_text(json.dumps(report, ensure_ascii=False, indent=2), encoding="utf-8")
    return out


def banners(meta: dict) -> list[str]:
    """What readers must know before the figures."""
    out = []
    if meta["normalize"]:
        out.append(normalize_disclosure(meta["threshold"], meta["threshold_provenance"]))
    if meta["deep_index_truncated"]:
        out.append("The index reached its cap: matches may be missing.")
    return out


_MD = str.maketrans({"\\": "\\\\", "`": "\\`", "|": "\\|", "<": "&lt;", ">": "&gt;"})


def markdown(report: dict) -> str:
    meta = report["metadata"]
    lines = [f"# {report['dir_a'].translate(_MD)} and {report['dir_b'].translate(_MD)}", "", *(f"> {b}\n" for b in banners(meta)), "| setting | value |", "| --- | --- |"]
    lines += [f"| {k} | {str(v).translate(_MD)} |" for k, v in meta.items()]
    lines += ["", "| file A | file B | name | line match | + | - | note |", "| --- | --- | --- | --- | --- | --- | --- |"]
    for r in report["results"]:
        note = r["error"] or ("binary" if r["binary"] else "")
        lines.append(f"| {r['file_a'].translate(_MD)} | {r['file_b'].translate(_MD)} | {r['name_similarity']:.1f} | {100 * r['ratio']:.1f} % | {r['additions']} | {r['deletions']} | {note.translate(_MD)} |")
    for side in "ab":
        names = report[f"unmatched_{side}"]
        if names:
            lines += ["", f"Only in {side.upper()}:", "", *(f"- {n.translate(_MD)}" for n in names)]
    if report["deep_results"]:
        lines += ["", "| file A | file B | shared | Jaccard | |", "| --- | --- | --- | --- | --- |"]
        for d in report["deep_results"]:
            for m in d["matches"]:
                lines.append(f"| {d['file_a'].translate(_MD)} | {m['file_b'].translate(_MD)} | {m['shared_hashes']} | {100 * m['jaccard']:.2f} % | {'inconclusive' if m['inconclusive'] else ''} |")
    return "\n".join(lines) + "\n"


def html_page(title: str, body: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>{body}</body></html>'


def _table(head: str, rows: list[list[str]]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
    return f"<table><tr>{''.join(f'<th>{h}</th>' for h in head.split('|'))}</tr>{cells}</table>"


def cover(report: dict, hashes: dict[str, list[dict]] | None = None) -> str:
    """Settings, pairs with their line match and changed lines, files without a partner, deep matches, and digests if given."""
    meta, safe = report["metadata"], html.escape
    body = [f"<h1>{safe(report['dir_a'])} and {safe(report['dir_b'])}</h1>", *(f"<p><b>{safe(b)}</b></p>" for b in banners(meta))]
    body.append(_table("setting|value", [[safe(k), safe(str(v))] for k, v in meta.items()]))
    pairs = [[safe(r["file_a"]), safe(r["file_b"]), f"{r['name_similarity']:.1f}", f"{100 * r['ratio']:.1f} %", f"+{r['additions']}", f"&minus;{r['deletions']}"] for r in report["results"]]
    body.append(_table("file A|file B|name|line match|added|deleted", pairs))
    for side in "ab":
        if report[f"unmatched_{side}"]:
            body.append(f"<h2>Only in {side.upper()}</h2>" + _table("file", [[safe(n)] for n in report[f"unmatched_{side}"]]))
    if report["deep_results"]:
        rows = [
            [safe(d["file_a"]), safe(m["file_b"]), str(m["shared_hashes"]), f"{100 * m['jaccard']:.2f} %", "inconclusive" if m["inconclusive"] else ""] for d in report["deep_results"] for m in d["matches"]
        ]
        body.append("<h2>Deep matches</h2>" + _table("file A|file B|shared|Jaccard|", rows))
    for side, entries in (hashes or {}).items():
        body.append(f"<h2>{side}</h2>" + _table("file|SHA-256", [[safe(e["rel_path"]), f"{e['sha256'][:16]}&hellip;{e['sha256'][-8:]}"] for e in entries]))
    return "".join(body)


def write_html(report: dict, out: Path, hashes: dict[str, list[dict]] | None = None) -> Path:
    """One page with the cover and every difference."""
    parts = [cover(report, hashes)]
    parts += [f"<h2>{html.escape(r['file_a'])}</h2>{r['html_diff'] or '<p>' + html.escape(r['error'] or 'binary') + '</p>'}" for r in report["results"]]
    out.write_text(html_page("comparison", "".join(parts)), encoding="utf-8")
    return out


def write_html_pages(results: DataFrame, report: dict, folder: Path, preserve_tree: bool = True) -> Path:
    """One page per pair, in the tree of the A paths or numbered side by side, and an index. Each task writes the pages of its rows, so ``folder`` is one that all workers share."""
    folder.mkdir(parents=True, exist_ok=True)
    place, style = str(folder), STYLE
    names = [f"{r['file_a']}.html" if preserve_tree else f"{n:03}_{re.sub(r'[^A-Za-z0-9._-]+', '_', r['file_a'].rsplit('/', 1)[-1])}.html" for n, r in enumerate(report["results"], 1)]
    links = [f'<li><a href="{html.escape(name)}">{html.escape(r["file_a"])}</a> {100 * r["ratio"]:.1f} %</li>' for name, r in zip(names, report["results"], strict=True)]
    named = results.sparkSession.createDataFrame([(r["file_a"], name) for r, name in zip(report["results"], names, strict=True)], "rel_path_a string, page string")

    def write(rows) -> None:
        for r in rows:
            target = Path(place) / r["page"]
            target.parent.mkdir(parents=True, exist_ok=True)
            body = r["html"] or html.escape(r["error"] or "binary")
            target.write_text(f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(r["rel_path_a"])}</title><style>{style}</style></head><body>{body}</body></html>', encoding="utf-8")

    results.select("rel_path_a", "html", "error").join(named, "rel_path_a").foreachPartition(write)
    (folder / "index.html").write_text(html_page("index", cover(report) + "<ul>" + "".join(links) + "</ul>"), encoding="utf-8")
    return folder / "index.html"


def short_digest(digest: Column) -> Column:
    """A digest as tables show it."""
    return F.concat(F.substring(digest, 1, 16), F.lit("…"), F.right(digest, F.lit(8)))


def bates(number: Column, prefix: str = "", suffix: str = "", width: int = 4) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")), F.lit(suffix))


def exhibit_index(results: DataFrame, pages: Column, *, bates_prefix: str = "", bates_suffix: str = "", bates_start: int | None = None) -> DataFrame:
    """Exhibits in report order (column ``ord``, unique) with the range of pages each takes, as Bates numbers if a start is given. Running sums over ranges of the order."""
    counted = running_totals(results.withColumn("pages", pages.cast("long")).withColumn("one", F.lit(1)), "ord", {"last_page": "pages", "exhibit": "one"})
    counted = counted.withColumn("first_page", F.col("last_page") - F.col("pages") + 1)
    number = (lambda c: bates(c + F.lit(bates_start - 1), bates_prefix, bates_suffix)) if bates_start is not None else (lambda c: c.cast("string"))
    return counted.select(F.col("exhibit").cast("int").alias("exhibit"), "rel_path_a", "rel_path_b", "similarity", "ratio", number(F.col("first_page")).alias("first"), number(F.col("last_page")).alias("last"))


def write_exhibits(index: DataFrame, out: Path) -> Path:
    with open(out, "w", encoding="utf-8-sig", newline="") as held:
        rows = csv.writer(held)
        rows.writerow(index.columns)
        for r in index.orderBy("exhibit").toLocalIterator():
            rows.writerow(list(r))
    return out


def write_lines(lines: list[str], out: Path) -> Path:
    out.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
    return out


def write_tables(run: dict, folder: str) -> None:
    """Every result as a table, in parallel: the form for results of any size."""
    for name in ("results", "deep", "unmatched_a", "unmatched_b"):
        if run[name] is not None:
            df = run[name].drop("ord")
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


__all__ = ["md_escape", "sort_results", "html_diff", "html_column", "report_dict", "write_json", "markdown", "write_html", "write_html_pages", "exhibit_index", "bates", "write_exhibits", "write_lines", "write_tables"]
