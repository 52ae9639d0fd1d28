"""Pairs of paths by shared keys against plain Python, and what is shuffled for them."""

import random

import pytest

from ctxgraph.operators import relations


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, key string").repartition(3)


def plain(rows):
    own = {}
    for p, k in rows:
        if p is not None and k is not None:
            own.setdefault(p, set()).add(k)
    return sorted((a, b, min(own[a] & own[b])) for a in own for b in own if a != b and own[a] & own[b])


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "block": 3, "task": 5}, {"chunk": 1, "block": 1}])
def test_shared_keys(spark, sizes):
    rng = random.Random(5)
    paths, keys = [None, *(f"p{i}" for i in range(25))], [None, "", "é", "Z", "z", *(f"k{i}" for i in range(12))]
    rows = [(rng.choice(paths), rng.choice(keys)) for _ in range(120)]
    rows += [(f"same{i}", k) for i in range(7) for k in ("k3", "k4", "z")] + [("lone", "only")]  # equal keys; a key of one path
    assert sorted(map(tuple, relations.shared_keys(frame(spark, rows), **sizes).collect())) == plain(rows)
    assert relations.shared_keys(frame(spark, rows).limit(0), **sizes).collect() == []


def shuffled(spark):
    return sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def test_pairs_of_a_hot_key_are_not_shuffled(spark):
    links = frame(spark, [(f"page {i}", k) for i in range(1500) for k in ("hot", f"group {i % 5}")])
    before = shuffled(spark)
    assert relations.shared_keys(links).count() == 1500 * 1499
    assert shuffled(spark) - before < 1_000_000


def test_long_lists_of_rare_keys(spark):
    rows = [(f"p{i}", f"{j:03d} {i // 2}") for i in range(300) for j in range(300)]
    before = shuffled(spark)
    assert sorted(map(tuple, relations.shared_keys(frame(spark, rows)).collect())) == sorted((f"p{i}", f"p{i ^ 1}", f"000 {i // 2}") for i in range(300))
    assert shuffled(spark) - before < 10_000_000
