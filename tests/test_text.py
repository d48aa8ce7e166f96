import random
import re

from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.comments import clean, strip_comments
from tracewright.functions.fingerprints import MODULUS, Winnower, fnv1a
from tracewright.functions.languages import Language, Registry
from tracewright.functions.tokens import flatten, lexed, tokens
from tracewright.operators.diffs import even_ws, lines_of


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def strings(seed=1, n=400):
    rng = random.Random(seed)
    alphabet = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x85  \xa0{}x"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(n)] + [""]


def test_lines_words_and_white_space(spark):
    values = strings()
    assert column(spark, values, T.split_lines) == [lines_of(v) for v in values]
    assert column(spark, values, T.words) == [v.split() for v in values]
    assert column(spark, values, T.normalize_ws) == [even_ws(v) for v in values]
    assert column(spark, values, T.squash_blank_lines) == [re.sub(r"(\n[ \t]*){3,}", "\n\n", v) for v in values]
    assert column(spark, ["\t\tint  x  = 5;\n", "\tint x;\r\n"], T.normalize_ws) == ["int x = 5;\n", "int x;\r\n"]


def test_names(spark):
    paths = ["a/b/x.tar.GZ", "a/.env", "a/b", "x.", ".a.b", "a.b/c"]
    from pathlib import PurePosixPath

    assert column(spark, paths, T.basename) == [PurePosixPath(p).name for p in paths]
    assert column(spark, paths[:3] + paths[4:], T.suffix) == [PurePosixPath(p).suffix.lower() for p in paths[:3] + paths[4:]]
    names = ["foo10.py", "foo2.py", "Foo.py", "foo1.py", "2", "10", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()]
    assert got == ["", "2", "10", "Foo.py", "foo1.py", "foo2.py", "foo10.py"] or got.index("foo2.py") < got.index("foo10.py")


def test_name_similarity(spark):
    pairs = [("StringIterate.java", "String.java"), ("FastList.java", "ArrayList.java"), ("a", ""), ("", ""), ("abc", "abc"), ("aaaa.py", "zzzz.py")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    slow = [r[0] for r in df.select(T.indel_ratio(F.col("a"), F.col("b"))).collect()]
    fast = [r[0] for r in df.select(T.indel_ratio_udf("a", "b")).collect()]
    assert slow == fast
    assert [round(x, 1) for x in fast[:2]] == [75.9, 74.1] and fast[4] == 100.0 and fast[5] < 80


def test_escapes(spark):
    assert column(spark, ["a|b`<d>\\"], T.md_escape) == ["a\\|b\\`&lt;d&gt;\\\\"]
    assert column(spark, ["<a href=\"x\">'&"], T.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"]
    assert column(spark, ["x 한글 y"], T.wrap_cjk) == ['x <span class="cjk">한글</span> y']


def test_comments_by_grammar():
    assert strip_comments('s = "# no" # yes\n', ".py") == 's = "# no" \n'
    assert strip_comments('"""doc # x"""\nx = 1 # c', ".py") == '"""doc # x"""\nx = 1 '
    assert strip_comments("int a; // x\n/* y\nz */ int b;", ".c") == "int a; \n\n int b;"
    assert strip_comments("const re = /foo\\/*bar/; // c\nlet x = a / b; // d", ".js") == "const re = /foo\\/*bar/; \nlet x = a / b; "
    assert strip_comments("const re = /foo/*bar/;\nnext();", ".js").endswith("next();")
    assert strip_comments("`a // ${x /* c */} b`; // d", ".js") == "`a // ${x } b`; "
    assert strip_comments("it's <!-- secret --> fine", ".html") == "it's  fine"
    assert strip_comments("a { color: red } /* x */", ".css") == "a { color: red } "
    assert strip_comments("x =begin\n=begin\nhid\n =end\n=end\ny # z", ".rb") == "x =begin\n\n\n\n\ny "
    assert strip_comments("-- a\nx = 1 --[[ b\nc ]] y", ".lua") == "\nx = 1 \n y"
    assert strip_comments("# x", ".xyz") == "# x"
    assert strip_comments("a\n#if 0\nb\n#if 1\nc\n#endif\nd\n#endif\ne", ".c") == "a\n\n\n\n\n\n\n\ne"
    assert strip_comments("a\n#if 0 // c\nb\n#endif", ".c").split("\n")[2] == "b"
    assert strip_comments("#if 0\n#ifdef X\n#endif\nb\n#endif", ".c").split("\n")[3] == "b"
    assert strip_comments("'unclosed\nx = 1 // c", ".java") == "'unclosed\nx = 1 "


def test_comment_columns_agree_with_the_scanner(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice(["<!--", "-->", "<", "-", "a", "\n", "/*", "*/", "/"]) for _ in range(12)) for _ in range(200)]
    for ext in (".html", ".css"):
        assert column(spark, values, lambda c, ext=ext: clean(c, F.lit(ext))) == [strip_comments(v, ext) for v in values]
    assert column(spark, ["x # y", None], lambda c: clean(c, F.lit(".py"))) == ["x ", None]


def test_registry_refuses_taken_extensions():
    import pytest

    registry = Registry()
    assert len(registry.extensions()) == 47
    registry.register(Language("Zig", (".zig",), registry.grammar(".c"), frozenset({"comptime"})))
    assert "comptime" in registry.keywords(".zig") and "comptime" in registry.keywords(".unknown") and "if" in registry.keywords(".c")
    with pytest.raises(ValueError):
        registry.register(Language("Other", (".zig",), registry.grammar(".c")))


def test_tokens(spark):
    assert column(spark, ["def foo(x): return x + 1", "pi = 3.14", "데이터 = 값"], tokens) == [
        "def foo ( x ) : return x + 1".split(),
        ["pi", "=", "3.14"],
        ["데이터", "=", "값"],
    ]
    assert column(spark, ["myVar + _b", 'x = "hello" 12'], lambda c: flatten(tokens(c))) == [["ID", "+", "ID"], ["ID", "=", "STR", "ID", "STR", "LIT"]]
    assert lexed("x = 1  # c", ".py") in (["ID", "=", "LIT"], None)
    assert lexed("x", ".nolexer") is None


def test_fingerprints_against_a_plain_model():
    import pytest

    rng = random.Random(3)

    def plain(seq, k, w):
        h = [sum(fnv1a(seq[i + j]) * 257 ** (k - 1 - j) for j in range(k)) % MODULUS for i in range(len(seq) - k + 1)]
        if not h:
            return []
        spots = [range(len(h))] if len(h) <= w else [range(i, i + w) for i in range(len(h) - w + 1)]
        picked = sorted({min(s, key=lambda p: (h[p], -p)) for s in spots})
        return [(h[p], p) for p in picked]

    for _ in range(60):
        k, w = rng.randrange(1, 6), rng.randrange(1, 6)
        seq = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert [(f["h"], f["pos"]) for f in Winnower(k, w).fingerprints(seq)] == plain(seq, k, w)
    shared = [f"t{i}" for i in range(14)]
    one = {f["h"] for f in Winnower(5, 10).fingerprints(["x", "y", *shared])}
    assert one & {f["h"] for f in Winnower(5, 10).fingerprints([*shared, "z"])}
    for k, w in ((0, 4), (5, 0)):
        with pytest.raises(ValueError):
            Winnower(k, w)


def test_registered_languages_reach_the_workers(spark):
    from tracewright.functions.languages import REGISTRY, Grammar, Language, register_language
    from tracewright.functions.tokens import flatten_by_language, tokens

    register_language(Language("Zed", (".zz",), Grammar(("%%",)), frozenset({"loop"})))
    try:
        df = spark.createDataFrame([("loop if x %% gone", ".zz"), ("if x 1 # y", ".py"), ("if loop", ".unknown"), (None, ".zz"), ("<!-- c -->t", ".html")], "t string, e string")
        rows = df.select(clean(F.col("t"), F.col("e")).alias("c"), flatten_by_language(tokens(F.col("t")), F.col("e")).alias("f")).collect()
        assert [r.c for r in rows] == ["loop if x ", "if x 1 ", "if loop", None, "t"]
        assert rows[0].f[:3] == ["loop", "ID", "ID"] and rows[1].f[:3] == ["if", "ID", "LIT"] and rows[2].f == ["if", "loop"] and rows[3].f is None
    finally:
        for e in (".zz",):
            REGISTRY._by_extension.pop(e)


def test_default_ignores():
    from tracewright.sources.srctree import DEFAULT_IGNORES, should_ignore

    gone = ["a/node_modules", "x.pyc", "A$py.class", "B.class", "web/.next", "venv", "target", ".DS_Store"]
    assert all(should_ignore(p, DEFAULT_IGNORES) for p in gone)
    assert not any(should_ignore(p, DEFAULT_IGNORES) for p in ("a/environment.py", "targets.c", "src/x.py", "classy.java"))
