import random

from pyspark.sql import functions as F

from tracewright.llm.topn import top_n_per_group


def test_equals_brute_force_with_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), f"i{rng.randrange(40):02}", rng.choice([0.1, 0.5, 0.5, 0.9])) for _ in range(600)]
    rows += [("hot", f"i{i:04}", 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i string, s double")
    got = top_n_per_group(df, ["g"], ["i"], [F.desc("s")], 5, rank_name="n").collect()
    want = {}
    for g, i, s in rows:
        best = want.setdefault(g, {})
        best[i] = max(best.get(i, 0), s)
    want = {g: sorted(((-s, i) for i, s in best.items()))[:5] for g, best in want.items()}
    assert {g: sorted((-r.s, r.i) for r in got if r.g == g) for g in want} == want
    assert all(r.n <= 5 for r in got)


def test_empty_none_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 7, 8)], "g string, i string, s double, _salt int, _rank int")
    out = top_n_per_group(df, ["g"], ["i"], [F.desc("s")], 2)
    assert out.columns == df.columns and out.collect() == df.collect()
    assert top_n_per_group(df, ["g"], ["i"], [F.desc("s")], 0).count() == 0
    assert top_n_per_group(df.limit(0), ["g"], ["i"], [F.desc("s")], 2).count() == 0
