from tracewright.llm.codeorigin import code_origins

HAND = "import sys\n\n\ndef load(path, limit=20):\n    # the generated report lands in out/\n    rows = []\n    for line in open(path):\n        if len(line) > 3:\n            rows.append(line)\n    return rows[:limit]\n"
WEIGHTS = HAND + "\nWEIGHTS = [22, 74, 75, 58, 81, 55, 51, 92, 1, 26, 14, 50, 17, 11, 75, 99]\n"
CASES = [
    ("t/a/src/x.py", HAND, None),
    ("t/a/src/w.py", WEIGHTS, None),
    ("t/a/codegen/x.py", HAND, None),
    ("t/a/vendor_accounts/x.py", HAND, None),
    ("t/a/build/x.py", HAND, None),
    ("t/a/src/team.py", "# (c) the harbour team, internal use, see LICENSE\n" + HAND, None),
    ("t/a/src/note.py", "# do not edit the settings file by hand, use this helper\n" + HAND, None),
    ("t/a/src/one.js", "module.exports = (a, b) => a.filter(x => !b.includes(x));\n", None),
    ("t/a/src/g.py", "# Code generated by schemac. DO NOT EDIT.\n" + HAND, "generated"),
    ("t/a/src/h.py", HAND + "# machine-made by x, source: y.proto, please change the source instead\n", "generated"),
    ("t/a/src/acc.py", "".join(f"def get_f_{i:03}(m):\n    return m._f[{i}]\n" for i in range(40)), "generated"),
    ("t/a/src/op.c", "".join(f"#define OP_{i:04} 0x{i * 17:04x}\n" for i in range(60)), "generated"),
    ("t/a/node_modules/lib/x.js", HAND, "vendored"),
    ("t/a/src/v.py", "# frob 1.2.3 - upstream copy, see the frob project for changes\n" + HAND, "vendored"),
    ("t/a/src/b.js", "!function(a,b){" + "var c=function(d){return d+1};" * 40 + "}()\n", "minified"),
    ("t/a/src/data.go", "var t = [\n" + "  [11.6,-106.0,\"x\"],\n" * 30 + "]\n", "data"),
    ("t/a/src/blob.py", "D = '" + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo5" * 20 + "'\n", "data"),
    ("t/a/src/empty.py", "", None),
    ("t/a/src/lost.py", None, None),
    ("t/a/site-packages/lib/lost.py", None, "vendored"),
    ("t/a/web/lost.min.js", None, "generated"),
    ("", "x = 1\n", None),
]


def test_each_case(spark):
    df = spark.createDataFrame([(p, c, i, "x") for i, (p, c, _) in enumerate(CASES)], "path string, content string, t int, layout string")
    df = df.union(df).union(spark.createDataFrame([(None, "x", 1, "x"), ("t/a/src/g.py", None, 99, "x")], df.schema))
    got = {r.path: r.origin for r in code_origins(df, "path", "content", "t").select("path", "origin").collect()}
    assert got == {p: o for p, _, o in CASES}


def test_very_long_and_no_files(spark):
    df = spark.createDataFrame([("a/b/long.py", HAND * 3000, 1)], "p string, c string, t int")
    assert code_origins(df, "p", "c", "t").first().origin is None
    assert code_origins(df.limit(0), "p", "c", "t").count() == 0
