import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import calibrate, deep, diffs, matching, postings


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "rel_path string")


def test_matching(spark):
    a = paths(spark, ["src/x.py", "old/util.py", "only/aaaa.py", "m/List.java", None, "src/x.py"])
    b = paths(spark, ["src/x.py", "new/util.py", "other/zzzz.py", "n/Lists.java"])
    matches, left_a, left_b = matching.match_files(a, b, 80)
    got = {(r.rel_path_a, r.rel_path_b): round(r.similarity, 1) for r in matches.collect()}
    assert got == {("src/x.py", "src/x.py"): 100.0, ("old/util.py", "new/util.py"): 100.0, ("m/List.java", "n/Lists.java"): 94.7}
    assert [r.rel_path for r in left_a.collect()] == ["only/aaaa.py"] and [r.rel_path for r in left_b.collect()] == ["other/zzzz.py"]
    kept = matching.keep_listed(matches, paths(spark, ["src/x.py", "nowhere"]))
    assert kept.count() == 1
    none = matching.match_files(a.limit(0), b, 60)
    assert [x.count() for x in none] == [0, 0, 4]


def test_names_of_any_length_are_candidates(spark):
    long_a, long_b = "m/" + "x" * 1500 + ".py", "n/" + "x" * 1501 + ".py"
    b = paths(spark, [long_b, "n/" + "q" * 400, "n/x"])
    found = {(r.rel_path_a, r.rel_path_b) for r in matching.name_candidates(paths(spark, [long_a]), b, 60).collect()}
    assert found == {(long_a, long_b)}
    # at the least thresholds a name may be more than 100 times longer than the other
    low = matching.name_candidates(paths(spark, ["m/q", "m/"]), b, 0).collect()
    assert {(r.rel_path_a, r.rel_path_b) for r in low} == {(x, r.rel_path) for x in ("m/q", "m/") for r in b.collect()}
    one = matching.name_candidates(paths(spark, ["m/q"]), b, 0.4).collect()
    assert {(r.rel_path_a, r.rel_path_b) for r in one} == {("m/q", "n/" + "q" * 400)}


def test_rounds_of_best_pairs_equal_the_sequential_choice(spark):
    rng = random.Random(2)
    rows = {(f"a{rng.randrange(12):02}", f"b{rng.randrange(12):02}"): float(rng.choice([70, 80, 90])) for _ in range(70)}
    df = spark.createDataFrame([(*k, s) for k, s in rows.items()], "rel_path_a string, rel_path_b string, similarity double")
    used, want = set(), set()
    for (a, b), _ in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    for one_group in (1, 100_000):
        assert {(r.rel_path_a, r.rel_path_b) for r in matching.greedy_assignment(df, one_group).collect()} == want


def sets(spark, rows):
    schema = "doc string, fps array<struct<h:bigint,pos:int>>, n_tokens bigint"
    data = [(d, [(h, i) for i, h in enumerate(hs)], t) for d, hs, t in rows]
    return spark.createDataFrame(data, schema).withColumn("n_fp", F.size("fps").cast("long"))


def test_deep_matches_rank_floor_and_cap(spark):
    a = sets(spark, [("x", [1, 2, 3, 4, 4], 44), ("y", [], 100)])
    b = sets(spark, [("p", [1, 2, 3, 4], 45), ("q", [1, 2, 3, 4], 44), ("r", [9], 50), ("s", [4, 10, 11, 12, 13], 50)])
    found = {r.doc_b: (r.shared, r.jaccard, r.inconclusive) for r in deep.deep_matches(a, b, 0.05, normalize=True).collect()}
    assert found == {"p": (4, 1.0, True), "q": (4, 1.0, True), "s": (1, 0.125, True)}
    nested = deep.nested(deep.deep_matches(a, b, 0.05), a).collect()
    assert [(m.file_b, m.inconclusive) for m in nested[0].matches] == [("p", False), ("q", False), ("s", False)]
    assert nested[0].fingerprint_count_a == 5
    assert deep.index_truncated(b, 5) and not deep.index_truncated(b, 100)
    assert deep.deep_matches(a, b, 0.05, max_index_entries=4).count() == 1


def test_deep_pairs_are_never_shuffled_and_are_those_of_the_joins(spark, monkeypatch):
    rng = random.Random(5)
    pool = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(30)]
    sides = [[(f"{s}{i}", rng.choice(pool) if i % 3 else [x for x in rng.choice(pool) if rng.random() < 0.9], rng.randint(40, 50)) for i in range(90)] for s in "ab"]
    a, b = (sets(spark, [*x, ("empty", [], 1)]) for x in sides)
    monkeypatch.setattr(postings, "SEGMENT_ENTRIES", 300)  # several segments
    for t, normalize, cap in ((0.05, False, None), (0.0, True, None), (0.8, True, None), (1.0, False, None), (0.2, False, 500)):
        found = deep.deep_matches(a, b, t, normalize=normalize, max_index_entries=cap)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of whole sets of A, before there are pairs
        ranks = deep.report_order(deep.matches_by_file(a, b, t, normalize=normalize, max_index_entries=cap)).select("doc_a", F.posexplode("found").alias("at", "m"))
        left, right = deep._sides(a, b)
        joins = deep._by_joins(left, right, t, deep.INCONCLUSIVE_TOKENS if normalize else None, cap).select("doc_a", F.inline("found"))
        want = sorted(tuple(r) for r in joins.collect())
        assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 50
        assert {(r.doc_a, r.m.doc_b, r["at"] + 1) for r in ranks.collect()} == {(r.doc_a, r.doc_b, r.match_rank) for r in deep.ranked(joins).collect()}


def test_diff(spark):
    assert diffs.diff("", "")["ratio"] == 1.0
    for a, b in (("x\ny\n", "x\r\ny\r\n"), ("x\ry", "x\ny\n")):
        d = diffs.diff(a, b)
        assert (d["ratio"], d["additions"], d["deletions"]) == (1.0, 0, 0)
    assert len(diffs.lines_of("a\x0cb\x85c d")) == 1
    d = diffs.diff("a b c", "a x c", by_word=True)
    assert (d["additions"], d["deletions"]) == (1, 1)
    df = spark.createDataFrame([("k", "a\nb\nc\n", "a\nc\nd\n"), ("n", None, "x")], "k string, a string, b string")
    rows = {r.k: r.d for r in df.select("k", diffs.diff_column(F.col("a"), F.col("b")).alias("d")).collect()}
    assert rows["k"].additions == 1 and rows["k"].deletions == 1 and rows["n"].additions == 1


def moved(spark, rows, **kw):
    """Blocks of pairs of lists of lines, given with or without opcodes."""
    given = [(k, a, b, o or diffs.diff("\n".join(a), "\n".join(b))["opcodes"]) for k, a, b, o in rows]
    df = spark.createDataFrame(given, f"k string, a array<string>, b array<string>, o array<{diffs.OPCODE}>")
    out = {}
    for r in diffs.moved_blocks(df, "k", "a", "b", "o", **kw).orderBy("k", "move_id").collect():
        out.setdefault(r.k, []).append((r.move_id, r.a_lines, r.b_lines))
    return out


def test_moved_blocks(spark):
    codes = [dict(zip(("tag", "i1", "i2", "j1", "j2"), c)) for c in (("delete", 0, 3, 0, 0), ("equal", 3, 5, 0, 2), ("insert", 5, 5, 2, 8))]
    whole = [dict(zip(("tag", "i1", "i2", "j1", "j2"), ("replace", 0, 20, 0, 20)))]
    rows = [
        ("given", "m0 m1 m2 x y".split(), "x y q r s m0 m1 m2".split(), codes),
        ("gap", ["m0", "m1", "zz", "m3", "x", "y", "w", "v"], ["x", "y", "w", "v", "q", "m0", "m1", "other", "m3"], None),
        ("braces", ["}", "}", "}", "x", "y", "w", "z"], ["x", "y", "w", "z", "}", "}", "}"], None),
        ("often", ["p", "p", "p", "q", "r", "x", "y", "w", "z"], ["x", "y", "w", "z", "p", "q", "r"], None),
        ("empty", [], [], None),
        ("space", ["a  b", "c\td", " e", "x", "y", "z", "u"], ["x", "y", "z", "u", "n", "a b", "c d", "e"], None),
        # two runs claim line 2: the longer has it, the shorter is left with two lines and no block
        ("claim", ["l0", "l1", "l2", "l3", *"abcdefghijklmnop"], ["l2", "l0", "l1", "l2", "l3", *"ABCDEFGHIJKLMNO"], whole),
    ]
    found = moved(spark, rows)
    assert found["given"] == [(0, [0, 1, 2], [5, 6, 7])]
    assert found["gap"][0][1] == [0, 1, 3]
    assert found["space"] == [(0, [0, 1, 2], [5, 6, 7])]
    assert found["claim"] == [(0, [0, 1, 2, 3], [1, 2, 3, 4])]
    assert set(found) == {"given", "gap", "space", "claim"}
    assert moved(spark, rows[:1], min_lines=4) == {}


def test_rows_fold(spark):
    a = [f"l{i}" for i in range(30)]
    b = a[:20] + ["new"] + a[20:]
    df = spark.createDataFrame([("k", a, b, diffs.diff("\n".join(a), "\n".join(b))["opcodes"])], f"k string, a array<string>, b array<string>, o array<{diffs.OPCODE}>")
    whole = diffs.diff_rows(df, "k", "a", "b", "o").collect()
    assert len(whole) == 31 and sum(r.tag == "insert" for r in whole) == 1
    folded = diffs.diff_rows(df, "k", "a", "b", "o", context=3).collect()
    assert sorted(r.text_a for r in folded if r.tag == "fold") == ["14 lines", "4 lines"]
    assert len(folded) == 3 + 3 + 1 + 3 + 3 + 2


@pytest.fixture(scope="module")
def pair_scores(spark):
    rows = [("c", f"n{i}", "neg", None, 700, "normalize", 0.1) for i in range(8)]
    rows += [("c", f"m{i}", "neg", None, 20, "normalize", 0.9) for i in range(2)]
    rows += [("c", f"p{i}", "pos", 1, 700, "normalize", 0.8) for i in range(10)]
    return spark.createDataFrame(rows, "case_name string, doc_key string, label string, level int, tokens_min int, mode string, jaccard double")


def test_calibration(spark, pair_scores):
    points = calibrate.frontier(pair_scores, 0.0)
    best = calibrate.recommended(points).first()
    assert best.floor > 20 and best.fp_rate == 0 and best.recall == 100 and best.coverage >= 0.5
    row = calibrate.sweep(pair_scores).where("threshold = 50").first()
    assert (row.fp_rate, row.fp_small, row.fp_large, row.recall_L1, row.recall_all) == (20.0, 100.0, 0.0, 100.0, 100.0)
    low, high = calibrate.wilson(F.lit(1), F.lit(105))
    ci = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(ci.l, 2), round(ci.h, 1)) == (0.17, 5.2)
    c = calibrate.confusion(pair_scores, 40, "normalize").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (10, 2, 0, 8)


def test_prefix_join_equals_the_full_count(spark):
    rng = random.Random(8)
    pool = [rng.randrange(10**6) for _ in range(40)]
    rows = [(f"d{i:02}", rng.sample(pool, rng.randrange(3, 25)), -1) for i in range(60)]
    rows += [(f"e{i}", rows[i][1][:-1] + [5], -1) for i in range(10)]
    a, b = sets(spark, rows[::2]), sets(spark, rows[1::2])
    for t in (0.3, 0.5, 0.8):
        counted = {(r.doc_a, r.doc_b): r.shared for r in deep.deep_matches(a, b, t, max_index_entries=10**9).collect()}
        assert {(r.doc_a, r.doc_b): r.shared for r in deep.deep_matches(a, b, t).collect()} == counted


def test_estimates(spark):
    from tracewright.operators import estimate

    one = spark.createDataFrame([("x", 1 << 20), ("y", 10)], "rel_path string, length bigint")
    scan = estimate.prescan(one, one)
    assert scan["pairs"] == 2 and round(scan["complexity"], 6) == 1.0
    assert estimate.first_phase_seconds(scan, deep=False) == 1.0
    assert round(estimate.second_phase_seconds(scan, 100.0, deep=False), 1) == 41.0


def test_deep_matches_gives_each_task_few_names(spark, monkeypatch):
    """A part of the result holds the names of one segment of B, so that a column format's dictionary holds them; sides are checkpointed without positions."""
    names = lambda s: [(f"{s}{i:04d}", [i % 7, 100 + i % 5, 1000 + i], 50) for i in range(200)]
    a, b = sets(spark, names("a")), sets(spark, names("b"))
    monkeypatch.setattr(postings, "NAME_BYTES", 500)
    found = deep.deep_matches(a, b, 0.05).withColumn("part", F.spark_partition_id())
    per = found.groupBy("part").agg(F.collect_set("doc_b").alias("b"), F.collect_set("doc_a").alias("a")).collect()
    assert per and all(sum(len(x) + 4 for x in names) <= 500 + 9 for r in per for names in (r.a, r.b))
    want = {(x, y) for x, hs, _ in names("a") for y, gs, _ in names("b") if {*hs} & {*gs}}
    assert {(r.doc_a, r.doc_b) for r in found.collect()} == want and found.count() == len(want)
    assert deep.hash_sets(a).columns == ["doc", "n_tokens", "n_fp", "hs"]
    assert {tuple(r) for r in deep.deep_matches(deep.hash_sets(a), b, 0.05).collect()} == {tuple(r) for r in found.drop("part").collect()}


def test_deep_ranked_gives_each_task_few_names_and_ranks_over_all_of_b(spark, monkeypatch):
    rng = random.Random(7)
    rows = lambda s, n: [(f"{s}{i:03d}", rng.sample(range(40), rng.randint(1, 20)), 50) for i in range(n)]
    a, b = sets(spark, rows("a", 25)), sets(spark, [*rows("b", 50), *((f"c{i}", [1, 2, 3], 50) for i in range(60))])
    want = {(r.doc_a, r.match_rank, r.doc_b, r.j) for r in deep.ranked(deep.deep_matches(a, b, 0.05)).withColumn("j", F.round("jaccard", 4)).collect()}
    monkeypatch.setattr(postings, "NAME_BYTES", 200)
    found = deep.deep_ranked(a, b, 0.05).withColumn("part", F.spark_partition_id()).collect()
    assert {tuple(r)[:4] for r in found} == want and len(found) == len(want)
    for part in {r.part for r in found}:
        assert sum(len(x) + 4 for x in {r.doc_b for r in found if r.part == part}) <= 200 + 8
