import random

from tracewright.llm.mixing import emit_copies, mix


def test_shares_meet_targets_within_the_caps(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randrange(20, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 800 + ["small"] * 150)]
    rows += [(9001, None, 50), (9002, "big", None), (9003, "big", 0), (9004, "stranger", 10)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 3), ("none", 0.0, 1), (None, 0.4, 1)]
    df = spark.createDataFrame(rows, "id bigint, source string, size bigint").selectExpr("*", "1 as copies", "'x' as rate")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    use, shares = mix(df, t, id_col="id", source_col="source", size_col="size")
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "mid", "small"}
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s].actual_share - want) < 0.03
        assert got[s].rate <= got[s].max_repeats
    assert any(abs(r.rate - r.max_repeats) < 1e-9 for r in got.values())
    used = use.collect()
    assert sorted(r.id for r in used) == sorted(r[0] for r in rows)
    assert {(r.rate, r.copies) for r in used if r.id > 9000} == {(None, 0)}
    used = [r for r in used if r.id < 9000]
    caps = {s: n for s, _, n in targets}
    assert all(int(got[r.source].rate) <= r.copies <= min(caps[r.source], int(got[r.source].rate) + 1) for r in used)
    assert emit_copies(use).count() == sum(r.copies for r in used)
    again = {r.id: r.copies for r in mix(df.repartition(7), t, id_col="id", source_col="source", size_col="size")[0].collect()}
    assert {k: n for k, n in again.items() if k < 9000} == {r.id: r.copies for r in used}


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, source string, size bigint")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    use, shares = mix(df, t, id_col="id", source_col="source", size_col="size")
    assert use.count() == 0 and shares.count() == 0
