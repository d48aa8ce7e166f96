"""Source files that nobody wrote by hand for their tree: generated, minified, vendored, or data in the form of code.

Layout statistics against thresholds tuned per language decide on the content: longest and mean line, share of
white space and of alphanumerics, density of numeric literals, long encoded runs, lines of mere data, and lines that
differ in their numbers only. Whole-line comments that announce a generator, and banners and package folders of third
parties, complete them. Everything is a Catalyst expression over one row: contents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per language: longest line and share of white space of minified code, mean line of minified code, density of numeric
#: literals of a data table. C and Go write tables of constants by hand, and no minifier is in use for them.
LIMITS = {
    "js": (250, 0.12, 120, 0.60),
    "ts": (250, 0.12, 120, 0.60),
    "css": (400, 0.10, 200, 0.80),
    "py": (300, 0.10, 140, 0.60),
    "java": (300, 0.10, 140, 0.60),
    "c": (300, 0.10, 140, 0.65),
    "go": (300, 0.10, 140, 0.65),
}
DEFAULT_LIMITS = (350, 0.10, 160, 0.65)
LANGUAGE_OF = {"mjs": "js", "jsx": "js", "tsx": "ts", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "pyw": "py", "kt": "java", "scala": "java"}

# What whole-line comments claim, in lower case, from parts that any such notice is made of. A file is said to be made by a program if a comment
# names the making and either a tool, by its options, version or name, or that edits belong elsewhere. Mentions of made things are no such claims.
_MADE = r"(?:auto-?(?:matically )?|machine-)?(?:generated|produced|emitted|created|made|compiled|built|output|erzeugt|erstellt|generiert|generado|g\u00e9n\u00e9r\u00e9)"
_BY = r"(?:by|from|of|with|von|mit|par|por)"
_ELSEWHERE = r"(?:do not|don't|never|please) (?:edit|modify|change|touch|alter)|(?:edit|change|modify|adjust) the (?:source|schema|grammar|template|input)"
_TOOL = r"\S+ --\w+|[\w.+-]*\w v?\d+(?:\.\d+)+"
GENERATED = (
    r"<auto-?generated\b|^\W*@generated\b|\bcode generated by"
    r"|\bauto-?generated file|(?:automatisch|automatiquement|autom\u00e1ticamente) (?:erzeugt|erstellt|generiert)|(?:g\u00e9n\u00e9r\u00e9|generado) autom"
    r"|(?:this|the) file (?:was|is|has been) (?:\w+ )?(?:auto-?generated|generated automatically|created automatically|machine.generated)"
    r"|\bautomatically generated " + _BY + r"|\bmachine-(?:made|generated) " + _BY
    + rf"|\b{_MADE} {_BY} (?:{_TOOL})"
    + rf"|\b{_MADE} {_BY} .*(?:{_ELSEWHERE})"
)
#: Third parties' code says where it comes from: taken from a release, under a licence, or with a record of what was changed here. A notice of a team of the house is none.
VENDORED = (
    r"\b(?:copied|taken|imported|vendored|forked|adapted|mirrored)(?: \w+)? from \S+ v?\d"
    r"|\b(?:upstream|third[- ]party|vendored) (?:copy|source|release|snapshot|code)\b"
    r"|\b(?:local|our|own) (?:fix|change|patch|modification|edit)\w* (?:is|are) (?:listed|recorded|documented|noted|kept|described)"
    r"|\b(?:released|distributed|licensed|available) under (?:the |an? )?[\w .-]*\b(?:licen[cs]e\b|mit\b|apache\b|bsd\b|isc\b|mpl\b|l?gpl)"
)
#: Folders that hold packages of third parties, each in a folder of its own.
PACKAGE_FOLDERS = (
    r"/(?:vendor|node_modules|bower_components|site-packages|third[-_]?party|3rdparty|externals?|deps|_workspace|Pods)/[^/]+/(?:.*/)?[^/]+$"
)
#: Names that generators and minifiers give; they decide only where there is no content.
MADE_NAMES = r"(?:[.-]min\.(?:js|css)|[.-]bundle\.js|\.pb\.(?:go|js|cc|h)|_pb2\.py|Grpc\.java|\.tab\.[ch]|\.gen\.[a-z]+|\.g\.[a-z]+|_generated\.[a-z]+)$"

_WHOLE_LINE_COMMENT = r"^\s*(?://|#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|error|line)\b)|/\*|\*|--|<!--)"
_NUMBERS = r"^[-+0-9.eExXa-fA-F,\s\[\]{}()]*[0-9][-+0-9.eExXa-fA-F,\s\[\]{}()]*;?$"
_TUPLE = r"""^[\[({]\s*(?:[-+0-9.eE]+\s*,\s*)+["'].*["']\s*[\])}],?;?$"""
_ENCODED = r"""^["'][A-Za-z0-9+/=\\]{40,}["'][\s+,\\]*\)?;?$"""
_LITERAL = r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|[0-9][0-9.]*)(?!\w)"


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    renamed = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.coalesce(F.element_at(renamed, ext), ext)


def _limit(lang: Column, at: int) -> Column:
    known = F.create_map(*(F.lit(x) for name, limits in LIMITS.items() for x in (name, float(limits[at]))))
    return F.coalesce(F.element_at(known, lang), F.lit(float(DEFAULT_LIMITS[at])))


def with_layout(df: DataFrame, path: str, content: str) -> DataFrame:
    """``df`` with a struct column ``layout`` of the statistics; null where ``content`` is null. Of code lines only, unless said otherwise."""
    lines = F.filter(F.split(F.col(content), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    comment = lambda x: x.rlike(_WHOLE_LINE_COMMENT)
    hash_marks = language(F.col(path)) == "py"
    tail = F.when(hash_marks, F.lit(r"(?<=\s)#.*$")).otherwise(F.lit(r"(?<=[\s;{}),])//.*$"))
    mark = F.when(hash_marks, F.lit("#")).otherwise(F.lit("//"))
    df = df.withColumn("_lines", lines).withColumn("_tail", tail).withColumn("_mark", mark)
    df = df.withColumn("_comments", F.filter("_lines", comment))
    bare = lambda x: F.when(F.contains(x, F.col("_mark")), F.regexp_replace(x, F.col("_tail"), F.lit(""))).otherwise(x)
    df = df.withColumn("_code", F.transform(F.filter("_lines", lambda x: ~comment(x)), bare))
    df = df.withColumn("_text", F.array_join("_code", "\n"))
    masked = F.transform(
        F.filter("_code", lambda x: (F.length(F.trim(x)) >= 12) & x.rlike("[0-9]")), lambda x: F.regexp_replace(F.trim(x), "0[xX][0-9a-fA-F]+|[0-9]+", "9")
    )
    df = df.withColumn("_numbered", masked)
    size = F.length("_text")
    n = F.size("_code")
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    data = F.size(F.filter("_code", lambda x: F.trim(x).rlike(f"{_NUMBERS}|{_TUPLE}|{_ENCODED}")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    literals, words = count(_LITERAL), count(r"[A-Za-z_]\w*")
    runs = F.transform(F.regexp_extract_all("_text", F.lit(r"[A-Za-z0-9+/=]{60,}|(?:\\x[0-9a-fA-F]{2}){15,}"), F.lit(0)), F.length)
    layout = F.struct(
        n.alias("code_lines"),
        F.coalesce(F.array_max(F.transform("_code", F.length)), F.lit(0)).alias("max_line"),
        share(size, n).alias("mean_line"),
        share(size - F.length(F.regexp_replace("_text", r"\s+", "")), size).alias("space_share"),
        share(size - F.length(F.regexp_replace("_text", r"[\p{L}\p{N}]+", "")), size).alias("alnum_share"),
        literals.alias("numeric_literals"),
        share(literals, literals + words).alias("numeric_density"),
        F.coalesce(F.array_max(runs), F.lit(0)).alias("encoded_run"),
        share(data, n).alias("data_share"),
        data.alias("data_lines"),
        F.size("_numbered").alias("numbered_lines"),
        share(F.size("_numbered"), F.size(F.array_distinct("_numbered"))).alias("numbered_repeats"),
        share(F.size("_numbered"), n).alias("numbered_share"),
        F.exists("_comments", lambda x: F.lower(x).rlike(GENERATED)).alias("says_generated"),
        F.exists("_comments", lambda x: F.lower(x).rlike(VENDORED)).alias("says_vendored"),
    )
    held = F.when(F.col(content).isNotNull(), layout).alias("layout")
    keep = [c for c in df.columns if c not in ("_lines", "_tail", "_mark", "_comments", "_code", "_text", "_numbered")]
    return df.select(*keep, held)


def origin(path: Column, layout: Column) -> Column:
    """generated, minified, data, vendored, or null for hand-written source. Without content, path and name alone decide."""
    lang = language(path)
    x = lambda name: layout[name]
    dense = x("space_share") <= _limit(lang, 1)
    minified = dense & ((x("max_line") >= _limit(lang, 0)) | ((x("mean_line") >= _limit(lang, 2)) & (x("code_lines") >= 3))) & (x("alnum_share") < 0.9)
    data = (
        ((x("data_share") >= 0.5) & (x("data_lines") >= 8))
        | ((x("numeric_density") >= _limit(lang, 3)) & (x("numeric_literals") >= 100))
        | (x("encoded_run") >= 120)
    )
    repeated = (x("numbered_lines") >= 16) & (x("numbered_repeats") >= 8) & (x("numbered_share") >= 0.4)
    return (
        F.when(x("says_vendored") | path.rlike(PACKAGE_FOLDERS), "vendored")
        .when(x("says_generated"), "generated")
        .when(data, "data")
        .when(repeated, "generated")
        .when(minified, "minified")
        .when(layout.isNull() & path.rlike(MADE_NAMES), "generated")
    )


def code_origins(files: DataFrame, path: str, content: str, seen_at: str) -> DataFrame:
    """``path``, ``origin``, ``layout``: one row per path of ``files``, by its latest content that is not null.

    Null paths are left out; of contents seen at one time, or all without a time, the longest counts. A file without any content is
    judged by its path, an empty one too. An empty table gives no rows.
    """
    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("_p"), F.col(content).alias("_c"), F.col(seen_at).alias("_t"))
    # the layout is computed next to the content and shuffled in its place
    at = F.struct(F.col("_t"), F.length("_c").alias("n"), F.xxhash64("_c").alias("h"))
    judged = with_layout(rows, "_p", "_c").withColumn("_at", F.when(F.col("_c").isNotNull(), at))
    latest = judged.groupBy("_p").agg(F.max_by("layout", "_at").alias("layout"))
    return latest.select(F.col("_p").alias(path), origin(F.col("_p"), F.col("layout")).alias("origin"), "layout")
