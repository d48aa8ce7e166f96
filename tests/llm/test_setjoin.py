import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm.set_queries import p3_links
from tracewright.llm.setjoin import ROW_VALUES, expand_pairs, link_counts, long_set_pairs, sets_of_arrays, sets_of_rows, similar_classes


def sample(seed=5, n=120):
    rng = random.Random(seed)
    base = [rng.sample(range(400), rng.randrange(3, 30)) for _ in range(25)]
    sets = {}
    for i in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 3 else s.add(rng.randrange(400))
        sets[f"k{i:03}"] = s
    return sets


def brute(sets, t=0.7):
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize("bucket", [400, 1])
def test_all_pairs_are_found_also_in_crowded_buckets(spark, bucket):
    sets = sample()
    df = spark.createDataFrame([(k, sorted(s) + [None, min(s)]) for k, s in sets.items()], "k string, v array<bigint>")
    members, pairs = similar_classes(sets_of_arrays(df, "k", "v", 3), 0.7, bucket_classes=bucket)
    found = expand_pairs(members, pairs).collect()
    assert len(found) == len({(r.key_1, r.key_2) for r in found})
    want = brute(sets)
    assert {(r.key_1, r.key_2) for r in found} == want
    links = {r.key: r.n_links for r in link_counts(members, pairs).collect()}
    assert links == {k: sum(k in p for p in want) for k in sets}


def test_long_sets_are_counted_without_gathering(spark):
    sets = {k: s for k, s in sample(9, 60).items()}
    df = spark.createDataFrame([(k, str(v)) for k, s in sets.items() for v in s], "k string, v string")
    short, long_rows = sets_of_rows(df, "k", "v", 3, threshold=0.7, row_values=12)
    members, pairs = similar_classes(short, 0.7)
    got = {(r.key_1, r.key_2) for r in expand_pairs(members, pairs).collect()}
    far = {(r.key_a, r.key_b) for r in long_set_pairs(long_rows, 0.7, row_values=12).collect()}
    assert not got & far and got | far == brute(sets)


def test_long_and_short_sets_meet_at_low_thresholds(spark):
    """A set of 24 values within one of 60: 0.4, which a limit of 50 values per row must not hide."""
    sets = {"long": set(range(60)), "short": set(range(24)), "tiny": set(range(15)), "far": set(range(100, 130))}
    df = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k string, v int")
    for t in (0.2, 0.35, 0.5):
        short, long_rows = sets_of_rows(df, "k", "v", 3, threshold=t, row_values=50)
        members, pairs = similar_classes(short, t, bands=80, rows=2)
        got = {(r.key_1, r.key_2) for r in expand_pairs(members, pairs).collect()}
        got |= {tuple(sorted((r.key_a, r.key_b))) for r in long_set_pairs(long_rows, t, row_values=50).collect()}
        assert got == brute(sets, t)


def test_parts_are_kept_apart_and_a_set_that_a_third_of_all_hold_is_one_class(spark):
    rng = random.Random(3)
    sets = {f"a{i}": {1, 2, 3, 4} for i in range(150)} | {f"b{i}": {1, 2, 3, 4} for i in range(3)} | {f"ax{i}": set(rng.sample(range(1000), 8)) for i in range(300)}
    df = spark.createDataFrame([(k, sorted(s), len(s)) for k, s in sets.items()], "key string, set array<bigint>, size int")
    for bucket in (400, 1):
        members, pairs = similar_classes(df, 0.7, bucket_classes=bucket, apart=F.substring("key", 1, 1))
        reps = {r.key: r.rep for r in members.collect()}
        assert {reps[f"a{i}"] for i in range(150)} == {"a0"} and {reps[f"b{i}"] for i in range(3)} == {"b0"} and len(reps) == len(sets)
        assert not [r for r in pairs.collect() if r.rep_a[0] != r.rep_b[0]]


def test_nulls_empty_and_small_sets(spark):
    rows = [("a", None), ("b", []), ("c", [1, 2]), (None, [1, 2, 3]), ("d", [None, None]), ("e", [1, 2, 3]), ("e", [3, 2, 1, 1])]
    sets = sets_of_arrays(spark.createDataFrame(rows, "k string, v array<bigint>"), "k", "v", 3)
    assert [(r.key, r.set) for r in sets.collect()] == [("e", [1, 2, 3])]
    members, pairs = similar_classes(sets.where(F.lit(False)), 0.7)
    assert expand_pairs(members, pairs).count() == 0


def test_links_have_a_row_for_every_long_set(spark, tmp_path):
    n = ROW_VALUES + 1
    # two equal long sets, one near them that fits a row, a long one and a short one without partners
    spans = [("q", 0, n), ("p", 0, n), ("a", 0, n - 2), ("z", 2 * n, 3 * n), ("c", 4 * n, 4 * n + 3)]
    items = F.transform(F.sequence("low", F.col("high") - 1), lambda i: F.struct(F.concat(F.lit("b"), i).alias("rel_path_b"), F.lit(1).alias("shared_hash_count"), F.lit(0.5).alias("jaccard")))
    rows = spark.createDataFrame(spans, "file_a string, low bigint, high bigint").select("file_a", items.alias("matched_files_b"))
    rows.write.parquet(f"{tmp_path}/deep_match_results.parquet")
    spark.createDataFrame([], "doc_key string, raw_fp array<bigint>, norm_fp array<bigint>").write.parquet(f"{tmp_path}/submission_docs.parquet")
    got = {(r.mode, r.key, r.class_key, r.n_links) for r in p3_links(spark, str(tmp_path)).collect()}
    want = {("a", "a", 2), ("p", "p", 2), ("q", "p", 2), ("z", "z", 0), ("c", "c", 0)}
    assert got == {("matched", *w) for w in want}
