import random

import pytest

from tracewright.llm.spans import chunk_spans, cuts, shared_spans


def brute(files, span):
    at = {}
    for f, seq in files.items():
        for i in range(len(seq) - span + 1):
            at.setdefault(tuple(v for _, v in seq[i : i + span]), set()).add(f)
    out = set()
    for f, seq in files.items():
        marked = [False] * len(seq)
        for i in range(len(seq) - span + 1):
            if len(at[tuple(v for _, v in seq[i : i + span])]) > 1:
                marked[i : i + span] = [True] * span
        i = 0
        while i < len(seq):
            if marked[i]:
                j = i
                while j + 1 < len(seq) and marked[j + 1]:
                    j += 1
                out.add((f, seq[i][0], seq[j][0], j - i + 1))
                i = j
            i += 1
    return out


def make(rng, n_files=14, alphabet=60):
    pool = [rng.randrange(alphabet) for _ in range(300)]
    files = {}
    for f in range(n_files):
        seq = []
        while len(seq) < rng.randrange(10, 200):
            if rng.random() < 0.4:
                a = rng.randrange(250)
                seq += pool[a : a + rng.randrange(5, 60)]
            elif rng.random() < 0.2:
                seq += [7] * rng.randrange(1, 40)
            else:
                seq += [rng.randrange(10**6) for _ in range(rng.randrange(1, 15))]
        gaps = iter(range(0, 10**6, 3))
        files[f"f{f:02}"] = [(next(gaps), v) for v in seq]
    return files


@pytest.mark.parametrize("seed,segment", [(1, 32_768), (2, 32_768), (3, 64), (4, 90)])
def test_runs_equal_brute_force_whatever_the_segments(spark, seed, segment):
    files = make(random.Random(seed))
    rows = [(f, p, v, "x") for f, seq in files.items() for p, v in seq]
    rows += rows[::3]
    rows += [(None, 1, 2, "x"), ("f00", None, 3, "x"), ("f00", 5, None, "x")]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "record string, pos int, value bigint, kind string")
    got = {tuple(r) for r in shared_spans(df, "record", "pos", "value", span=20, segment=segment).collect()}
    assert got == brute(files, 20)
    only = spark.createDataFrame([("f03",), ("f04",), (None,), ("f04",)], "p string")
    some = {tuple(r) for r in shared_spans(df, "record", "pos", "value", span=20, only=only, segment=segment).collect()}
    assert some == {x for x in got if x[0] in ("f03", "f04")}


def test_empty_and_short(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "r string, p int, v bigint")
    assert shared_spans(df, "r", "p", "v").count() == 0
    assert shared_spans(df.limit(0), "r", "p", "v").count() == 0


def test_cuts_survive_an_insertion():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**60, 500)
    b = np.concatenate([a[:100], rng.integers(0, 2**60, 7), a[100:]])
    assert (cuts(a)[110:] == cuts(b)[117:]).all()
    start, stop = chunk_spans(a, 20)
    assert ((stop - start) <= 20).all()
