import random

import pytest

from tracewright.llm.components import connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def groups(spark, pairs, kind="string"):
    df = spark.createDataFrame(pairs, f"x {kind}, y {kind}")
    rows = connected_groups(df, "x", "y", record="r", group="g").collect()
    assert len({r.r for r in rows}) == len(rows)
    return {r.r: r.g for r in rows}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "ring"])
def test_groups_equal_union_find(spark, shape):
    rng = random.Random(7)
    n = 120
    if shape == "random":
        pairs = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(80)]
    elif shape == "chain":
        order = list(range(n))
        rng.shuffle(order)
        pairs = [(f"n{a:03}", f"n{b:03}") for a, b in zip(order, order[1:])]
    elif shape == "star":
        pairs = [("n050", f"n{i:03}") for i in range(n)]
    else:
        pairs = [(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)]
    assert groups(spark, pairs) == brute(pairs)


def test_nulls_loops_repeats_and_empty(spark):
    pairs = [("a", None), (None, "b"), (None, None), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e"), ("", "f")]
    assert groups(spark, pairs) == brute(pairs) == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "d", "": "", "f": ""}
    assert groups(spark, []) == {}


def test_other_columns_and_numbers(spark):
    df = spark.createDataFrame([(2, 1, "x"), (3, 2, "y")], "u bigint, node bigint, label string")
    rows = connected_groups(df, "u", "node", record="u", group="label").collect()
    assert {(r.u, r.label) for r in rows} == {(1, 1), (2, 1), (3, 1)}
