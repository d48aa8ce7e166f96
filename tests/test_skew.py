from collections import Counter

from pyspark.sql import functions as F

from tracewright.operators.skew import aggregate_skewed, count_distinct_rows, heavy_keys, heavy_share, lookup_join, running_totals, split_heavy, spread_join


def skewed(spark):
    rows = [("hot", i % 700, f"f{i % 50}") for i in range(4000)] + [(f"k{i % 300}", i, f"f{i % 50}") for i in range(1500)] + [(None, 1, "f1")] * 5
    return rows, spark.createDataFrame(rows, "k string, p int, f string")


def test_heavy_keys_finds_what_holds_most(spark):
    _, df = skewed(spark)
    assert "hot" in heavy_keys(df, "k", share=0.05)
    assert heavy_keys(df.limit(0), "k") == []
    hot, rest = split_heavy(df, "k", ["hot"])
    assert hot.count() == 4000 and rest.count() == 1505


def test_counts_equal_brute_force_with_any_list(spark):
    rows, df = skewed(spark)
    want = Counter(k for k, p, f in set(rows))
    for heavy in (None, [], ["hot"], ["hot", "k1", "absent"]):
        got = count_distinct_rows(df.withColumn("n_rows", F.lit(1)), ["k"], ["p", "f"], heavy=heavy)
        assert {r.k: r.n_rows for r in got.collect()} == want


def test_aggregate_in_two_steps(spark):
    rows, df = skewed(spark)
    partial = {"n": F.count(F.lit(1)), "d": F.count_distinct("f"), "hi": F.max("p")}
    final = {"n": F.sum("n"), "d": F.sum("d"), "hi": F.max("hi")}
    for heavy in (None, [], ["hot"]):
        got = {r.k: (r.n, r.d, r.hi) for r in aggregate_skewed(df, ["k"], partial, final, spread_by=["f"], heavy=heavy).collect()}
        assert got["hot"] == (4000, 50, 699) and got[None] == (5, 1, 1) and len(got) == 302
    assert aggregate_skewed(df.limit(0), ["k"], partial, final, spread_by=["f"]).count() == 0


def test_share_follows_the_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, share in (("4", 0.001), ("5000", 0.0001), ("1000000", 2e-5)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert heavy_share(spark) == share
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    _, df = skewed(spark)
    assert "hot" in heavy_keys(df, "k", share=2e-5)


def test_rows_of_a_hot_key_are_spread(spark):
    """A key with a third of all rows: no task of the counting gets more than three times the mean."""
    rows = spark.range(60_000, numPartitions=8).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7001)) as k", "id as p")
    hot, rest = split_heavy(rows, "k", heavy_keys(rows, "k", share=0.01))
    sizes = [r[0] for part in (hot.repartition(16, "k", "p"), rest.repartition(16, "k")) for r in part.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 3 * 60_000 / 32


def test_lookup_join_is_the_same_on_every_way(spark):
    _, df = skewed(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, x int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, df.join(dim, "k", how).collect()))
        assert sorted(map(str, lookup_join(df, dim, "k", how).collect())) == plain
        assert sorted(map(str, lookup_join(df, dim, "k", how, broadcast_rows=1).collect())) == plain
        two, pair = df.withColumn("y", F.lit(7)), dim.withColumn("y", F.lit(7))
        plain = sorted(map(str, two.join(pair, ["k", "y"], how).collect()))
        assert sorted(map(str, lookup_join(two, pair, ["k", "y"], how, broadcast_rows=1, heavy=["hot"]).collect())) == plain


def test_running_totals(spark):
    rows = [(i, i * 7 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, v int").withColumn("one", F.lit(1))
    got = {r.o: (r.s, r.n) for r in running_totals(df.repartition(5), "o", {"s": "v", "n": "one"}).collect()}
    held = 0
    for o, v in rows:
        held += v
        assert got[o] == (held, o + 1)
    assert running_totals(df.limit(0), "o", {"s": "v"}).count() == 0


def test_spread_join_is_the_plain_join_and_spreads_a_hot_key(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(1800)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i % 50}", i) for i in range(120)], "k string, b int")
    plain = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for heavy in (None, [], ["hot"]):
        got = spread_join(left, right, "k", "a", heavy=heavy, salts=8).select("k", "a", "b")
        assert sorted(map(tuple, got.collect())) == plain
    assert spread_join(left.limit(0), right, "k", "a").count() == 0
    hot = left.where("k = 'hot'").withColumn("s", F.pmod(F.xxhash64("a"), F.lit(8)))
    assert max(r["count"] for r in hot.groupBy("s").count().collect()) < 3 * 900 / 8
