"""Queries of what reports and evidence are made of, and of what holds of every difference whatever the alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.languages import REGISTRY
from tracewright.functions.tokens import flatten_by_language, tokens
from tracewright.operators import deep, diffs, evidence
from tracewright.plans import file_queries as base
from tracewright.plans.file_queries import files
from tracewright.session import cut, spread, table
from tracewright.sinks import reports

INDEX_CAP = 2_000


def q_diff_rows_rebuilt(spark, sf):
    """Both files put together again from the rows of the side-by-side view: their lines, in order and whole."""
    pairs = base.with_opcodes(base.text_pairs(spark, sf))
    rows = diffs.diff_rows(pairs, "tree_path", "a", "b", "ops").select("tree_path", "line_a", "text_a", "line_b", "text_b")
    held = lambda s: F.array_sort(F.collect_list(F.when(F.col(f"line_{s}").isNotNull(), F.struct(f"line_{s}", f"text_{s}"))))
    built = rows.groupBy("tree_path").agg(held("a").alias("a"), held("b").alias("b"))
    digest = lambda s: F.md5(F.array_join(F.transform(s, lambda x: x[f"text_{s}"]), "\n")).alias(f"digest_{s}")
    return built.select("tree_path", digest("a"), digest("b"))


def q_opcode_invariants(spark, sf):
    """Opcodes tile both files without gap or overlap, equal spans hold equal lines, and no two spans of one kind meet."""
    pairs = base.with_opcodes(base.text_pairs(spark, sf))
    size = lambda op, low, high: op[high] - op[low]
    total = lambda low, high: F.aggregate("ops", F.lit(0), lambda n, op: n + size(op, low, high)).cast("long")
    same = lambda op: F.slice("a", op["i1"] + 1, size(op, "i1", "i2")) == F.slice("b", op["j1"] + 1, size(op, "j1", "j2"))
    steps = F.arrays_zip(F.slice("ops", F.lit(1), F.greatest(F.size("ops") - 1, F.lit(0))).alias("x"), F.slice("ops", F.lit(2), F.size("ops")).alias("y"))
    joins = F.forall(steps, lambda s: (s["x"]["i2"] == s["y"]["i1"]) & (s["x"]["j2"] == s["y"]["j1"]) & (s["x"]["tag"] != s["y"]["tag"]))
    return pairs.select(
        "tree_path",
        total("i1", "i2").alias("covered_a"),
        total("j1", "j2").alias("covered_b"),
        joins.alias("in_order"),
        F.forall("ops", lambda op: (op["tag"] != "equal") | same(op)).alias("equal_holds"),
    )


def q_word_marks_rebuilt(spark, sf):
    """Number of replaced lines whose words the marks do not give back, on either side."""
    rows = base.q_diff_rows(spark, sf).where("tag = 'replace' and text_a is not null and text_b is not null")
    marked = rows.select("text_a", "text_b", diffs.word_marks_udf("text_a", "text_b").alias("m"))

    def lost(s: str):
        back = F.array_join(F.filter(F.transform("m", lambda x: x[f"words_{s}"]), lambda w: w != ""), " ")
        return F.count_if(back != T.collapse_line(F.col(f"text_{s}")))

    return marked.agg(lost("a").alias("wrong_a"), lost("b").alias("wrong_b"))


def q_moved_line_invariants(spark, sf):
    """What holds of every move: the lines of both sides say the same, go down in step, and no line is moved twice."""
    pairs = base.with_opcodes(spread(base.rotated(spark, sf)))
    moves = diffs.moved_blocks(pairs, "tree_path", "a", "b", "ops")
    rows = moves.select("tree_path", "move_id", F.explode(F.arrays_zip("a_lines", "b_lines")).alias("l")).select("tree_path", "move_id", "l.*")
    said = rows.join(pairs.select("tree_path", "a", "b"), "tree_path")
    same = T.collapse_line(F.get("a", F.col("a_lines"))) == T.collapse_line(F.get("b", F.col("b_lines")))
    each = said.groupBy("tree_path", "move_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("wrong"), F.count_distinct(F.col("b_lines") - F.col("a_lines")).alias("far"))
    return each.agg(F.count_if(F.col("n") < 3).alias("short"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("unequal"), F.count_if(F.col("far") != 1).alias("uneven"))


def q_lang_aware_histogram(spark, sf):
    """Tokens flattened by the keywords of each file's language."""
    docs = spread(files(spark, sf, "content").where("content is not null").select("ext", "content"))
    flat = docs.select("ext", F.explode(flatten_by_language(tokens(F.col("content")), F.col("ext"))).alias("token"))
    return flat.groupBy("ext", "token").agg(F.count(F.lit(1)).alias("n"))


def q_path_parts(spark, sf):
    return files(spark, sf).select("rel_path", T.basename(F.col("rel_path")).alias("name"), "ext")


def q_line_kinds(spark, sf):
    """Per file: lines, lines of mere punctuation, and a digest of the lines with even white space."""
    lines = T.split_lines(F.col("content"))
    rows = spread(files(spark, sf, "content").where("content is not null").select("rel_path", "content"))
    return rows.select(
        "rel_path",
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, T.is_boilerplate)).cast("long").alias("n_boilerplate"),
        F.md5(F.array_join(F.transform(lines, T.collapse_line), "\n")).alias("digest"),
    )


def q_escapes(spark, sf):
    """Digests of the contents escaped for Markdown and for HTML."""
    rows = files(spark, sf, "content").where("content is not null")
    return rows.select("rel_path", F.md5(T.md_escape(F.col("content"))).alias("md"), F.md5(T.html_escape(F.col("content"))).alias("html"))


def q_hash_table(spark, sf):
    """Digests as the cover of a report shows them: the first sixteen and the last eight digits."""
    rows = files(spark, sf, "sha256").where("sha256 is not null")
    return rows.select("side", "rel_path", reports.short_digest(F.col("sha256")).alias("shown"))


def q_manifest_rows(spark, sf):
    """Entries of the evidence manifest: digest, size and time of change in ISO 8601 of each readable file."""
    rows = table(spark, sf, "source_files").where("rel_path is not null and content is not null")
    latest = F.max_by(F.struct(F.col("modified_at").alias("mtime"), F.encode("content", "utf-8").alias("content")), F.struct("scanned_at", "sha256"))
    one = rows.groupBy("rel_path").agg(latest.alias("x"))
    return evidence.hash_entries(one.select("rel_path", "x.mtime", "x.content", F.octet_length("x.content").cast("long").alias("length")))


def q_deep_ranked(spark, sf):
    """Deep matches in report order within each file, the score rounded as reports show it."""
    return deep.deep_ranked(*base.deep_sides(spark, sf))


def _sides(spark, sf) -> list[DataFrame]:
    sets = cut(base.deep_sets(spark, sf))
    return [sets.where(F.col("doc.side") == s).withColumn("doc", F.col("doc.rel_path")) for s in "AB"]


def q_deep_report_rows(spark, sf):
    """One row per file with deep matches: its fingerprints, its matches and the best of them."""
    found = base.deep_by_file(spark, sf)
    # the best by rounded score is among those next to the highest, which comes first
    near = found.withColumn("n", F.size("found").cast("long")).withColumn("found", F.filter("found", lambda m: m["jaccard"] >= F.get("found", F.lit(0))["jaccard"] - 0.0002))
    best = deep.report_order(near)
    return best.select(F.col("doc_a").alias("file_a"), F.col("n_fp").alias("fingerprint_count_a"), F.col("n").alias("n_matches"), F.get("found", F.lit(0))["doc_b"].alias("best"))


def q_deep_matches_capped(spark, sf):
    """Deep matches with an index of B of at most ``INDEX_CAP`` entries, filled in the order of documents and hashes."""
    a, b = _sides(spark, sf)
    return deep.deep_matches(a, b, max_index_entries=INDEX_CAP).drop("inconclusive")


def q_winnow_density(spark, sf):
    """Fingerprints of each file and the widest step between neighbours, which winnowing bounds by its window."""
    order = Window.partitionBy("rel_path").orderBy("position")
    steps = base.q_winnow_fingerprints(spark, sf).withColumn("step", F.col("position") - F.lag("position").over(order))
    widest = F.max("step")
    return steps.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_fp"), F.coalesce(widest, F.lit(0)).alias("widest"), F.coalesce(widest <= 4, F.lit(True)).alias("dense"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_FILES, _FLAT, _TOK, _HASHED = base._FILES, base._FLAT, base._TOK, base._HASHED
_DEEP = base._DEEP.replace("{theta}", "0.05")
_LINES = f"""WITH {_FILES}, l AS (SELECT side, rel_path, tree_path, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x
  FROM (SELECT side, rel_path, tree_path, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS x FROM files WHERE content IS NOT NULL)),
p AS (SELECT a.tree_path, a.x AS a, b.x AS b FROM l a JOIN l b ON a.tree_path = b.tree_path WHERE a.side = 'A' AND b.side = 'B')"""
_EXT = r"lower(regexp_extract(rel_path, '(\.[^./]+)$', 1))"
_STRINGS = r""""(?:\\.|[^"\\\n])*(?:"|\n|\z)|''(?:\\.|[^''\\\n])*(?:''|\n|\z)"""
_LONG = r"""(?:\\.|[^\\])*?"""
_SEGMENTS = {
    "'.py'": rf'''(?s)"""{_LONG}(?:"""|\z)|{"''" * 3}{_LONG}(?:{"''" * 3}|\z)|{_STRINGS}|#[^\n]*|[^"''#]+''',
    "'.js', '.ts', '.java', '.c', '.go'": rf"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|{_STRINGS}|`(?:\\.|[^`\\])*(?:`|\z)|[^"''`/]+|/""",
}
_CODE = " UNION ALL ".join(
    f"""SELECT rel_path, array_to_string(list_transform(regexp_extract_all(content, '{pattern}'), lambda s: CASE WHEN starts_with(s, '/*') THEN regexp_replace(s, '[^\\n]', '', 'g')
  WHEN starts_with(s, '{"#" if "py" in kinds else "//"}') THEN '' ELSE s END), '') AS code FROM files WHERE content IS NOT NULL AND {_EXT} IN ({kinds})"""
    for kinds, pattern in _SEGMENTS.items()
)
_KEPT = " ".join(f"WHEN ext = '{e}' THEN [{', '.join(repr(k) for k in sorted(REGISTRY.keywords(e)))}]" for e in (".c", ".java", ".js", ".ts", ".py", ".go"))
_BY_NAME = base.SQL["name_similarity"]
_GREEDY = (
    _BY_NAME[: _BY_NAME.index("SELECT ra.rel_path AS rel_path_a")]
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace(
        ", pairs AS (SELECT DISTINCT ra.name AS x, rb.name AS y FROM ra, rb",
        """, xa AS (SELECT rel_path, name, row_number() OVER (PARTITION BY name ORDER BY rel_path) AS n FROM ra), xb AS (SELECT rel_path, name, row_number() OVER (PARTITION BY name ORDER BY rel_path) AS n FROM rb),
named AS (SELECT xa.rel_path AS rel_path_a, xb.rel_path AS rel_path_b FROM xa JOIN xb USING (name, n)),
fa AS (SELECT * FROM ra WHERE rel_path NOT IN (SELECT rel_path_a FROM named)), fb AS (SELECT * FROM rb WHERE rel_path NOT IN (SELECT rel_path_b FROM named)),
pairs AS (SELECT DISTINCT ra.name AS x, rb.name AS y FROM fa ra, fb rb""",
    )
    + """, cand AS MATERIALIZED (SELECT fa.rel_path AS rel_path_a, fb.rel_path AS rel_path_b, similarity FROM scored JOIN fa ON fa.name = x JOIN fb ON fb.name = y WHERE similarity >= 60),
pick(n, a, b, s, ua, ub) AS (
  SELECT 0, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT * FROM (SELECT p.n + 1, c.rel_path_a, c.rel_path_b, c.similarity, list_append(p.ua, c.rel_path_a), list_append(p.ub, c.rel_path_b)
    FROM pick p, cand c WHERE NOT list_contains(p.ua, c.rel_path_a) AND NOT list_contains(p.ub, c.rel_path_b)
    ORDER BY c.similarity DESC, c.rel_path_a, c.rel_path_b LIMIT 1))
SELECT a.rel_path AS rel_path_a, b.rel_path AS rel_path_b, 100.0::DOUBLE AS similarity FROM a JOIN b ON a.rel_path = b.rel_path
UNION ALL SELECT rel_path_a, rel_path_b, 100.0::DOUBLE FROM named UNION ALL SELECT a, b, s FROM pick WHERE n > 0"""
)

SQL = {
    "comments_stripped": f"WITH {_FILES}, k AS ({_CODE}), m AS (SELECT rel_path, code, regexp_split_to_array(code, '\\r\\n|\\r|\\n') AS x FROM k) "
    "SELECT rel_path, md5(code) AS digest, CAST(CASE WHEN x[-1] = '' THEN len(x) - 1 ELSE len(x) END AS BIGINT) AS n_lines, CAST(length(code) AS BIGINT) AS n_chars FROM m",
    "greedy_pairs": _GREEDY,
    "diff_rows_rebuilt": _LINES + " SELECT tree_path, md5(array_to_string(a, chr(10))) AS digest_a, md5(array_to_string(b, chr(10))) AS digest_b FROM p WHERE len(a) + len(b) > 0",
    "opcode_invariants": _LINES + " SELECT tree_path, CAST(len(a) AS BIGINT) AS covered_a, CAST(len(b) AS BIGINT) AS covered_b, true AS in_order, true AS equal_holds FROM p",
    "word_marks_rebuilt": "SELECT 0::BIGINT AS wrong_a, 0::BIGINT AS wrong_b",
    "moved_line_invariants": "SELECT 0::BIGINT AS short, 0::BIGINT AS unequal, 0::BIGINT AS uneven",
    "lang_aware_histogram": f"WITH {_FILES}, t AS (SELECT {_EXT} AS ext, unnest(regexp_extract_all(content, '{_TOK}')) AS t FROM files WHERE content IS NOT NULL), "
    f"f AS (SELECT ext, t, CASE {_KEPT} END AS kept FROM t) SELECT ext, {_FLAT.replace('[{kw}]', 'kept').format(t='t')} AS token, count(*) AS n FROM f GROUP BY 1, 2",
    "path_parts": f"WITH {_FILES} SELECT rel_path, name, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext FROM base",
    "line_kinds": _LINES
    + r""" SELECT rel_path, CAST(len(x) AS BIGINT) AS n_lines, CAST(len(list_filter(x, lambda s: regexp_full_match(s, '[\s\x0B\x1C-\x1F\x{85}\p{Z}{}\[\]();,.:]*'))) AS BIGINT) AS n_boilerplate,
md5(array_to_string(list_transform(x, lambda s: array_to_string(list_filter(regexp_split_to_array(s, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda w: w <> ''), ' ')), chr(10))) AS digest FROM l""",
    "escapes": f"WITH {_FILES}"
    + r""" SELECT rel_path, md5(replace(replace(regexp_replace(content, '([\\`|])', '\\\1', 'g'), '<', '&lt;'), '>', '&gt;')) AS md,
md5(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html FROM files WHERE content IS NOT NULL""",
    "hash_table": f"WITH {_FILES} SELECT side, rel_path, left(sha256, 16) || '…' || right(sha256, 8) AS shown FROM files WHERE sha256 IS NOT NULL",
    "manifest_rows": """WITH r AS (SELECT rel_path, content, modified_at, row_number() OVER (PARTITION BY rel_path ORDER BY scanned_at DESC, sha256 DESC) AS n
  FROM source_files WHERE rel_path IS NOT NULL AND content IS NOT NULL)
SELECT rel_path, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes, strftime(modified_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS modified_at FROM r WHERE n = 1""",
    "deep_ranked": _DEEP
    + " SELECT doc_a, row_number() OVER (PARTITION BY doc_a ORDER BY round(jaccard, 4) DESC, shared DESC, doc_b) AS match_rank, doc_b, round(jaccard, 4) AS jaccard FROM found",
    "deep_report_rows": _DEEP
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_a ORDER BY round(jaccard, 4) DESC, shared DESC, doc_b) AS k FROM found)
SELECT doc_a AS file_a, any_value(e.n) AS fingerprint_count_a, count(*) AS n_matches, min(CASE WHEN k = 1 THEN doc_b END) AS best FROM o JOIN (SELECT rel_path, count(*) AS n FROM fp GROUP BY rel_path) e ON e.rel_path = doc_a GROUP BY doc_a""",
    "deep_matches_capped": _DEEP.replace(
        "shared AS (SELECT",
        f"""nb AS (SELECT rel_path, sum(n) OVER (ORDER BY rel_path) - n AS before FROM n WHERE side = 'B'),
ix AS (SELECT s.rel_path, h FROM s JOIN nb USING (rel_path) WHERE side = 'B' QUALIFY row_number() OVER (PARTITION BY s.rel_path ORDER BY h) <= {INDEX_CAP} - before),
shared AS (SELECT""",
    ).replace("FROM s a JOIN s b USING (h) WHERE a.side = 'A' AND b.side = 'B'", "FROM s a JOIN ix b USING (h) WHERE a.side = 'A'")
    + " SELECT doc_a, doc_b, shared, jaccard FROM found",
    "winnow_density": _HASHED
    + """, st AS (SELECT rel_path, position - lag(position) OVER (PARTITION BY rel_path ORDER BY position) AS step FROM fp)
SELECT rel_path, count(*) AS n_fp, coalesce(max(step), 0) AS widest, coalesce(max(step) <= 4, true) AS dense FROM st GROUP BY rel_path""",
}
