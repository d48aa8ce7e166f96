"""Queries of file comparison over source_files and documents, with the SQL that states them.

Side A and side B of a tree are ``<tree>/a/...`` and ``<tree>/b/...``; files match exactly where tree and inner path agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.comments import clean, strip_css_comments, strip_markup_comments
from tracewright.functions.fingerprints import fingerprints, fnv_mod, kgram_hashes
from tracewright.functions.languages import COMMON_KEYWORDS
from tracewright.functions.tokens import flatten, tokens
from tracewright.operators import deep, diffs, matching
from tracewright.session import cut, spread, table


def tree_path(path: Column) -> Column:
    return F.regexp_replace(path, "^([^/]+)/[ab]/", "$1/")


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per file, the latest scan: side, rel_path, tree_path, ext and the ``columns`` asked for (content, size_bytes, sha256).

    Scans of one time are told apart by digest. Columns that are not asked for are neither read nor shuffled: contents of a path-only query stay where they are.
    """
    rows = table(spark, sf_dir, "source_files").where("rel_path is not null").select("rel_path", "scanned_at", "side", *dict.fromkeys(["sha256", *columns]))
    one = rows.groupBy("rel_path").agg(F.max_by(F.struct("side", *columns), F.struct("scanned_at", "sha256")).alias("x"))
    return one.select("x.side", "rel_path", tree_path(F.col("rel_path")).alias("tree_path"), T.suffix(F.col("rel_path")).alias("ext"), *(f"x.{c}" for c in columns))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = files(spark, sf_dir).select("side", F.col("tree_path").alias("rel_path"))
    return one.where("side = 'A'").select("rel_path"), one.where("side = 'B'").select("rel_path")


_FILES = """
files AS (
  SELECT DISTINCT side, rel_path, regexp_replace(rel_path, '^([^/]+)/[ab]/', '\\1/') AS tree_path, content, size_bytes, sha256
  FROM source_files WHERE rel_path IS NOT NULL),
base AS (SELECT *, string_split(rel_path, '/')[-1] AS name FROM files)"""


def q_token_counts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).cast("long").alias("n_tokens"))


def q_normalized_token_histogram(spark, sf):
    docs = spread(files(spark, sf, "content").where("content is not null").select("content"))
    flat = docs.select(F.explode(flatten(tokens(F.col("content")))).alias("token"))
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(spark, sf) -> DataFrame:
    docs = files(spark, sf, "content").where("content is not null")
    return docs.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).distinct()


def q_vocab_fnv(spark, sf):
    return _vocabulary(spark, sf).select("token", fnv_mod("token").alias("fnv"))


def _source_tokens(spark, sf) -> DataFrame:
    return spread(files(spark, sf, "content").where("content is not null").select("side", "rel_path", "content")).select("side", "rel_path", tokens(F.col("content")).alias("tokens"))


def q_kgram_hashes(spark, sf):
    rows = _source_tokens(spark, sf).select("rel_path", F.posexplode(kgram_hashes(F.col("tokens"))).alias("position", "h"))
    return rows.select("rel_path", F.col("position").cast("long").alias("position"), "h")


def _prints(spark, sf) -> DataFrame:
    return _source_tokens(spark, sf).select("side", "rel_path", F.explode(fingerprints(F.col("tokens"))).alias("f")).select("side", "rel_path", "f.h", F.col("f.pos").cast("long").alias("position"))


def q_winnow_fingerprints(spark, sf):
    return _prints(spark, sf).select("rel_path", "h", "position")


def q_fingerprint_df(spark, sf):
    once = _prints(spark, sf).groupBy("h", "rel_path").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("h").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_entries"))


def deep_sets(spark, sf, normalize=False) -> DataFrame:
    docs = spread(files(spark, sf, "content").where("content is not null").select("side", "rel_path", "content"))
    return deep.fingerprint_sets(docs.select(F.struct("side", "rel_path").alias("doc"), "content"), "doc", "content", normalize=normalize)


def deep_sides(spark, sf, normalize=False) -> list[DataFrame]:
    sets = cut(deep.hash_sets(deep_sets(spark, sf, normalize)))
    return [sets.where(F.col("doc.side") == s).withColumn("doc", F.col("doc.rel_path")) for s in "AB"]


def deep_by_file(spark, sf, threshold=deep.THRESHOLD, normalize=False) -> DataFrame:
    return deep.matches_by_file(*deep_sides(spark, sf, normalize), threshold, normalize=normalize)


def q_deep_matches(spark, sf):
    return deep.deep_matches(*deep_sides(spark, sf)).drop("inconclusive")


def q_deep_matches_normalized(spark, sf):
    return deep_by_file(spark, sf, deep.NORMALIZE_THRESHOLD / 100, normalize=True).select("doc_a", F.inline("found"))


def q_deep_top1(spark, sf):
    return deep_by_file(spark, sf).select("doc_a", F.get("found", F.lit(0)).alias("x")).select("doc_a", "x.doc_b", "x.shared", "x.jaccard")


def q_exact_match(spark, sf):
    return matching.exact_pairs(*sides(spark, sf))


def q_unmatched_a(spark, sf):
    a, b = sides(spark, sf)
    return a.join(b, "rel_path", "left_anti")


def q_unmatched_b(spark, sf):
    a, b = sides(spark, sf)
    return b.join(a, "rel_path", "left_anti")


def q_name_similarity(spark, sf):
    a, b = sides(spark, sf)
    both = matching.name_candidates(cut(a.join(b, "rel_path", "left_anti")), cut(b.join(a, "rel_path", "left_anti")), 60.0)
    return both


def q_basename_pairing(spark, sf):
    a, b = sides(spark, sf)
    return matching.pair_equal_names(cut(a.join(b, "rel_path", "left_anti")), cut(b.join(a, "rel_path", "left_anti")))


def q_greedy_pairs(spark, sf):
    return matching.match_files(*sides(spark, sf))[0]


def q_sha256_manifest(spark, sf):
    return files(spark, sf, "content").where("content is not null").select("rel_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


def q_hash_match(spark, sf):
    one = files(spark, sf, "sha256")
    a = one.where("side = 'A'").select("tree_path", F.col("sha256").alias("sha_a"))
    b = one.where("side = 'B'").select("tree_path", F.col("sha256").alias("sha_b"))
    return a.join(b, "tree_path").select("tree_path", F.coalesce(F.col("sha_a") == F.col("sha_b"), F.lit(False)).alias("equal"))


def q_whitespace_normalized(spark, sf):
    return files(spark, sf, "content").where("content is not null").select("rel_path", F.md5(T.normalize_ws(F.col("content"))).alias("digest"))


def q_squash_blank_lines(spark, sf):
    return files(spark, sf, "content").where("content is not null").select("rel_path", F.md5(T.squash_blank_lines(F.col("content"))).alias("digest"))


def q_line_counts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.split_lines(F.col("text"))).cast("long").alias("n_lines"))


def q_word_counts(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


def q_markup_comments_stripped(spark, sf):
    content = F.col("content")
    return files(spark, sf, "content").where("content is not null").select("rel_path", F.md5(strip_css_comments(content)).alias("css_digest"), F.md5(strip_markup_comments(content)).alias("html_digest"))


def q_comments_stripped(spark, sf):
    """Source without comments by each file's own grammar: digest, lines and characters that stay."""
    code = clean(F.col("content"), F.col("ext"))
    cleaned = spread(files(spark, sf, "content").where("content is not null").select("rel_path", "ext", "content")).select("rel_path", code.alias("code"))
    return cleaned.select("rel_path", F.md5("code").alias("digest"), F.size(T.split_lines(F.col("code"))).cast("long").alias("n_lines"), F.length("code").cast("long").alias("n_chars"))


def q_natural_sort_rank(spark, sf):
    names = files(spark, sf).select(F.split("rel_path", "/")[0].alias("tree"), T.basename(F.col("rel_path")).alias("name")).distinct()
    return names.select("tree", "name", F.rank().over(Window.partitionBy("tree").orderBy(T.natural_key(F.col("name")))).cast("long").alias("rank"))


def q_ignore_filter(spark, sf):
    from tracewright.sources.srctree import ignored

    return files(spark, sf).where(~ignored(F.col("rel_path"), ["node_modules", "*.min.js", "**/vendor/**"])).select("rel_path")


def q_prescan(spark, sf):
    """Files and bytes per tree and side, and of the pairs with equal paths."""
    one = files(spark, sf, "size_bytes").where("size_bytes is not null").select("side", "tree_path", "size_bytes", F.split("tree_path", "/")[0].alias("tree"))
    total = one.groupBy("tree").agg(*(F.sum(F.when(F.col("side") == s, F.col("size_bytes")).otherwise(0)).alias(f"bytes_{s.lower()}") for s in "AB"), F.count(F.lit(1)).alias("n_files"))
    a, b = (one.where(F.col("side") == s).select("tree", "tree_path", F.col("size_bytes").alias(f"s_{s}")) for s in "AB")
    pairs = a.join(b, ["tree", "tree_path"]).groupBy("tree").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("s_A") * F.col("s_B")).alias("complexity"))
    return total.join(pairs, "tree", "left").na.fill(0, ["n_pairs", "complexity"])


def text_pairs(spark, sf) -> DataFrame:
    """Files matched by equal paths, with both contents."""
    one = files(spark, sf, "content").where("content is not null")
    a = one.where("side = 'A'").select("tree_path", F.col("content").alias("text_a"))
    return spread(a.join(one.where("side = 'B'").select("tree_path", F.col("content").alias("text_b")), "tree_path"))


def q_pair_metrics(spark, sf):
    d = diffs.diff_column(F.col("text_a"), F.col("text_b"))
    return text_pairs(spark, sf).select("tree_path", d.alias("d")).select("tree_path", "d.ratio", "d.additions", "d.deletions")


def q_pair_metric_invariants(spark, sf):
    """What holds of every difference whatever the alignment: lines of both sides, net change, and the ratio from the counters."""
    d = diffs.diff_column(F.col("text_a"), F.col("text_b"))
    rows = text_pairs(spark, sf).select("tree_path", d.alias("d")).select("tree_path", "d.*")
    same = F.when(F.col("units_a") + F.col("units_b") == 0, F.lit(1.0)).otherwise(2 * (F.col("units_a") - F.col("deletions")) / (F.col("units_a") + F.col("units_b")))
    return rows.select("tree_path", "units_a", "units_b", (F.col("additions") - F.col("deletions")).alias("net"), (F.abs(same - F.col("ratio")) < 1e-12).alias("ratio_holds"), (F.col("ratio") == 1).alias("equal"))


def q_opcodes(spark, sf):
    d = diffs.diff_column(F.col("text_a"), F.col("text_b"))
    return text_pairs(spark, sf).select("tree_path", F.posexplode(d["opcodes"]).alias("seq", "op")).select("tree_path", "seq", "op.*")


def rotated(spark, sf) -> DataFrame:
    """Each readable file against itself with its middle third of lines moved to the end: pairs that are known to hold a move."""
    one = files(spark, sf, "content").where("content is not null").select("rel_path", T.split_lines(F.col("content")).alias("a"))
    n = F.size("a")
    third = F.floor(n / 3).cast("int")
    turned = F.concat(F.slice("a", F.lit(1), third), F.slice("a", 2 * third + 1, n - 2 * third), F.slice("a", third + 1, third))
    return one.where(n >= 9).select(F.col("rel_path").alias("tree_path"), F.array_join("a", "\n").alias("text_a"), F.array_join(turned, "\n").alias("text_b"))


def with_opcodes(pairs: DataFrame) -> DataFrame:
    d = diffs.diff_column(F.col("text_a"), F.col("text_b"))
    return cut(pairs.select("tree_path", T.split_lines(F.col("text_a")).alias("a"), T.split_lines(F.col("text_b")).alias("b"), d["opcodes"].alias("ops")))


def q_moved_blocks(spark, sf):
    """Moved blocks of the matched pairs, and of each file against itself with its middle third moved to the end."""
    pairs = with_opcodes(spread(text_pairs(spark, sf).unionByName(rotated(spark, sf).withColumn("tree_path", F.concat(F.lit("turned:"), "tree_path")))))
    return diffs.moved_blocks(pairs, "tree_path", "a", "b", "ops")


def q_diff_rows(spark, sf):
    d = diffs.diff_column(F.col("text_a"), F.col("text_b"))
    pairs = text_pairs(spark, sf).select("tree_path", T.split_lines(F.col("text_a")).alias("a"), T.split_lines(F.col("text_b")).alias("b"), d["opcodes"].alias("ops"))
    return diffs.diff_rows(pairs, "tree_path", "a", "b", "ops", context=3)


def q_word_diff(spark, sf):
    """Word marks of each replaced line of the matched pairs."""
    rows = q_diff_rows(spark, sf).where("tag = 'replace' and text_a is not null and text_b is not null")
    return rows.select("tree_path", "line_a", "line_b", diffs.word_marks_udf("text_a", "text_b").alias("marks"))


_TOK = r"[0-9]+(?:\.[0-9]+)?|[\p{L}\p{N}_]+|[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_P = "2305843009213693951"
_HASHED = f"""
WITH {_FILES},
tok AS (SELECT side, rel_path, unnest(tk) AS t, generate_subscripts(tk, 1) - 1 AS p
  FROM (SELECT side, rel_path, regexp_extract_all(content, '{_TOK}') AS tk FROM files WHERE content IS NOT NULL)),
voc AS (
  SELECT t, list_reduce(list_prepend(14695981039346656037::hugeint,
    list_transform(range(0, octet_length(encode(t))::int), lambda i: ('0x'||substr(hex(encode(t)),2*i+1,2))::int::hugeint)),
    lambda h, x: (xor(h, x) * 1099511628211::hugeint) % 18446744073709551616::hugeint) % {_P}::hugeint AS f
  FROM (SELECT DISTINCT t FROM tok)),
h AS (SELECT side, rel_path, p, f,
  lead(f, 1) OVER w AS f1, lead(f, 2) OVER w AS f2, lead(f, 3) OVER w AS f3, lead(f, 4) OVER w AS f4
  FROM tok JOIN voc USING (t) WINDOW w AS (PARTITION BY rel_path ORDER BY p)),
k AS (SELECT side, rel_path, p, CAST(((((f * 257 + f1) % {_P} * 257 + f2) % {_P} * 257 + f3) % {_P} * 257 + f4) % {_P} AS BIGINT) AS h
  FROM h WHERE f4 IS NOT NULL),
win AS (SELECT side, rel_path, p, min(struct_pack(h := h, np := -p)) OVER w AS m, count(*) OVER w AS c, count(*) OVER (PARTITION BY rel_path) AS nk
  FROM k WINDOW w AS (PARTITION BY rel_path ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
fp AS (SELECT DISTINCT side, rel_path, m.h AS h, -m.np AS position FROM win WHERE c = 4 OR (nk < 4 AND p = 0))"""
_DEEP = (
    _HASHED
    + """,
s AS (SELECT DISTINCT side, rel_path, h FROM fp),
n AS (SELECT side, rel_path, count(*) AS n FROM s GROUP BY side, rel_path),
shared AS (SELECT a.rel_path AS doc_a, b.rel_path AS doc_b, count(*) AS shared FROM s a JOIN s b USING (h) WHERE a.side = 'A' AND b.side = 'B' GROUP BY 1, 2),
found AS (
  SELECT doc_a, doc_b, shared, shared / CAST(na.n + nb.n - shared AS DOUBLE) AS jaccard
  FROM shared JOIN n na ON na.rel_path = doc_a JOIN n nb ON nb.rel_path = doc_b WHERE shared / CAST(na.n + nb.n - shared AS DOUBLE) >= {theta})"""
)
_FLAT = "CASE WHEN list_contains([{kw}], {t}) THEN {t} WHEN regexp_matches({t}, '^[\\p{{L}}_]') THEN 'ID' WHEN regexp_matches({t}, '^\\p{{Nd}}') THEN 'LIT' WHEN {t} IN ('\"', '''', '`') THEN 'STR' ELSE {t} END"
_KW = ", ".join(f"'{w}'" for w in COMMON_KEYWORDS)
_REST = (
    f"WITH {_FILES}, a AS (SELECT tree_path AS rel_path, name FROM base WHERE side = 'A'), b AS (SELECT tree_path AS rel_path, name FROM base WHERE side = 'B'), "
    "ra AS (SELECT * FROM a ANTI JOIN b USING (rel_path)), rb AS (SELECT * FROM b ANTI JOIN a USING (rel_path))"
)

QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "token_counts": f"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{_TOK}')), 0) AS BIGINT) AS n_tokens FROM documents",
    "normalized_token_histogram": f"WITH {_FILES}, t AS (SELECT unnest(regexp_extract_all(content, '{_TOK}')) AS t FROM files WHERE content IS NOT NULL) SELECT {_FLAT.format(kw=_KW, t='t')} AS token, count(*) AS n FROM t GROUP BY 1",
    "vocab_fnv": _HASHED + " SELECT t AS token, CAST(f AS BIGINT) AS fnv FROM voc",
    "kgram_hashes": _HASHED + " SELECT rel_path, p AS position, h FROM k",
    "winnow_fingerprints": _HASHED + " SELECT rel_path, h, position FROM fp",
    "fingerprint_df": _HASHED + " SELECT h, count(DISTINCT rel_path) AS n_files, count(*) AS n_entries FROM fp GROUP BY h",
    "deep_matches": _DEEP.replace("{theta}", "0.05") + " SELECT doc_a, doc_b, shared, jaccard FROM found",
    "deep_top1": _DEEP.replace("{theta}", "0.05") + " SELECT doc_a, doc_b, shared, jaccard FROM found QUALIFY row_number() OVER (PARTITION BY doc_a ORDER BY jaccard DESC, shared DESC, doc_b) = 1",
    "deep_matches_normalized": _DEEP.replace("unnest(tk) AS t,", "unnest(list_transform(tk, lambda x: " + _FLAT.format(kw=_KW, t="x") + ")) AS t,").replace("{theta}", "0.93")
    + f""", sizes AS (SELECT rel_path, len(regexp_extract_all(content, '{_TOK}')) AS t FROM files WHERE content IS NOT NULL)
SELECT doc_a, doc_b, shared, jaccard, least(x.t, y.t) < 45 AS inconclusive FROM found JOIN sizes x ON x.rel_path = doc_a JOIN sizes y ON y.rel_path = doc_b""",
    "exact_match": f"WITH {_FILES} SELECT a.tree_path AS rel_path_a, b.tree_path AS rel_path_b, 100.0::DOUBLE AS similarity FROM files a JOIN files b ON a.tree_path = b.tree_path WHERE a.side = 'A' AND b.side = 'B'",
    "unmatched_a": _REST + " SELECT rel_path FROM ra",
    "unmatched_b": _REST + " SELECT rel_path FROM rb",
    "name_similarity": _REST
    + """, pairs AS (SELECT DISTINCT ra.name AS x, rb.name AS y FROM ra, rb WHERE 200.0 * least(length(ra.name), length(rb.name)) >= 60 * (length(ra.name) + length(rb.name))),
lcs AS (SELECT x, y, list_reduce(list_prepend(list_transform(range(0, length(y)::int + 1), lambda i: 0), list_transform(string_split(x, ''), lambda c: [ascii(c)])),
  lambda prev, c: list_reduce(list_prepend([0], list_transform(range(1, length(y)::int + 1), lambda j: [j::int])),
    lambda row, j: list_append(row, CASE WHEN ascii(substr(y, j[1], 1)) = c[1] THEN prev[j[1]] + 1 ELSE greatest(row[len(row)], prev[j[1] + 1]) END)))[-1] AS l FROM pairs),
scored AS (SELECT x, y, 100.0 * (1.0 - (length(x) + length(y) - 2 * l) / CAST(length(x) + length(y) AS DOUBLE)) AS similarity FROM lcs)
SELECT ra.rel_path AS rel_path_a, rb.rel_path AS rel_path_b, similarity FROM scored JOIN ra ON ra.name = x JOIN rb ON rb.name = y WHERE similarity >= 60""",
    "basename_pairing": _REST
    + """, xa AS (SELECT rel_path, name, row_number() OVER (PARTITION BY name ORDER BY rel_path) AS n FROM ra), xb AS (SELECT rel_path, name, row_number() OVER (PARTITION BY name ORDER BY rel_path) AS n FROM rb)
SELECT xa.rel_path AS rel_path_a, xb.rel_path AS rel_path_b, 100.0::DOUBLE AS similarity FROM xa JOIN xb USING (name, n)""",
    "sha256_manifest": f"WITH {_FILES} SELECT rel_path, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes FROM files WHERE content IS NOT NULL",
    "hash_match": f"WITH {_FILES} SELECT a.tree_path, coalesce(a.sha256 = b.sha256, false) AS equal FROM files a JOIN files b ON a.tree_path = b.tree_path WHERE a.side = 'A' AND b.side = 'B'",
    "whitespace_normalized": f"WITH {_FILES} SELECT rel_path, md5(regexp_replace(regexp_replace(content, '[ \\t]+', ' ', 'g'), '(^|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}])[ ]+', '\\1', 'g')) AS digest FROM files WHERE content IS NOT NULL",
    "squash_blank_lines": f"WITH {_FILES} SELECT rel_path, md5(regexp_replace(content, '(\\n[ \\t]*){{3,}}', chr(10) || chr(10), 'g')) AS digest FROM files WHERE content IS NOT NULL",
    "line_counts": "SELECT doc_id, CAST(CASE WHEN x[-1] = '' THEN len(x) - 1 ELSE len(x) END AS BIGINT) AS n_lines FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS x FROM documents WHERE text IS NOT NULL)",
    "word_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+')) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL",
    "markup_comments_stripped": f"""WITH {_FILES} SELECT rel_path,
md5(array_to_string(list_transform(regexp_extract_all(content, '(?s)/\\*.*?(?:\\*/|\\z)|[^/]+|/'), lambda s: CASE WHEN starts_with(s, '/*') THEN regexp_replace(s, '[^\\n]', '', 'g') ELSE s END), '')) AS css_digest,
md5(array_to_string(list_transform(regexp_extract_all(content, '(?s)<!--.*?(?:-->|\\z)|[^<]+|<'), lambda s: CASE WHEN starts_with(s, '<!--') THEN regexp_replace(s, '[^\\n]', '', 'g') ELSE s END), '')) AS html_digest
FROM files WHERE content IS NOT NULL""",
    "natural_sort_rank": f"""WITH {_FILES}, names AS (SELECT DISTINCT string_split(rel_path, '/')[1] AS tree, name FROM base)
SELECT tree, name, rank() OVER (PARTITION BY tree ORDER BY list_transform(list_filter(regexp_extract_all(lower(name), '\\D*\\d*'), lambda x: x <> ''),
lambda x: {{'t': regexp_extract(x, '^(\\D*)', 1), 'n': coalesce(TRY_CAST(regexp_extract(x, '(\\d*)$', 1) AS DECIMAL(38,0)), -1)}})) AS rank FROM names""",
    "ignore_filter": f"WITH {_FILES} SELECT rel_path FROM files WHERE NOT regexp_matches(rel_path, '(^|/)node_modules(/|$)') AND NOT regexp_matches(rel_path, '\\.min\\.js(/|$)') AND NOT regexp_matches(rel_path, '/vendor/')",
    "prescan": f"""WITH {_FILES}, f AS (SELECT *, string_split(tree_path, '/')[1] AS tree FROM files WHERE size_bytes IS NOT NULL),
t AS (SELECT tree, CAST(sum(CASE WHEN side = 'A' THEN size_bytes ELSE 0 END) AS BIGINT) AS bytes_a, CAST(sum(CASE WHEN side = 'B' THEN size_bytes ELSE 0 END) AS BIGINT) AS bytes_b, count(*) AS n_files FROM f GROUP BY tree),
p AS (SELECT a.tree, count(*) AS n_pairs, CAST(sum(a.size_bytes * b.size_bytes) AS BIGINT) AS complexity FROM f a JOIN f b ON a.tree_path = b.tree_path WHERE a.side = 'A' AND b.side = 'B' GROUP BY a.tree)
SELECT tree, bytes_a, bytes_b, n_files, coalesce(n_pairs, 0) AS n_pairs, coalesce(complexity, 0) AS complexity FROM t LEFT JOIN p USING (tree)""",
    "pair_metric_invariants": f"""WITH {_FILES}, l AS (SELECT side, tree_path, content, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM (SELECT side, tree_path, content, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS x FROM files WHERE content IS NOT NULL))
SELECT a.tree_path, CAST(len(a.x) AS BIGINT) AS units_a, CAST(len(b.x) AS BIGINT) AS units_b, CAST(len(b.x) - len(a.x) AS BIGINT) AS net, true AS ratio_holds, a.x = b.x AS equal
FROM l a JOIN l b ON a.tree_path = b.tree_path WHERE a.side = 'A' AND b.side = 'B'""",
}
