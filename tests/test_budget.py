"""Folds against plain loops."""

import random

from pyspark.sql import functions as F

from ctxgraph.functions import text as T
from ctxgraph.operators import budget, snapshot


def greedy(tokens, limit, free):
    out = []
    for t, f in zip(tokens, free):
        ok = f or t <= limit
        limit -= t if ok and not f else 0
        out.append(ok)
    return out


def test_greedy(spark):
    rng = random.Random(1)
    cases = [([50, 70, 30, 20], 100, [False] * 4), ([50, 10], 10, [True, False]), ([0, 5, 0], 3, [False] * 3)]
    for _ in range(4):
        n = rng.randint(1, 60)
        cases.append(([rng.randint(0, 40) for _ in range(n)], rng.randint(1, 300), [rng.random() < 0.1 for _ in range(n)]))
    for tokens, limit, free in cases:
        rows = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(tokens, free))], "rank long, tokens long, free boolean")
        for chunk in (3, 1000):
            got = [r.included for r in budget.greedy(rows, limit, free="free", chunk=chunk).orderBy("rank").collect()]
            assert got == greedy(tokens, limit, free)
    assert budget.greedy(rows, 0).where("NOT included").isEmpty()


def test_mode_ladder(spark):
    items = [(1, 0, 10, True, "auto"), (2, 90, 1000, False, "auto"), (3, 90, 2000, False, "auto"), (4, 76, 5000, False, "auto"), (5, 50, 5000, False, "auto"), (6, 10, 5000, False, "auto"), (7, 50, 10, False, "tree_only")]
    rows = spark.createDataFrame([(f"p{n}", s, t, seed, p) for n, s, t, seed, p in items], "path string, score int, token_estimate long, is_seed boolean, content_policy string")
    got = budget.modes(rows, [F.col("path")]).orderBy("path").collect()
    assert [r.content_mode for r in got] == ["full", "full", "full", "excerpt", "outline", "outline", "tree"]
    assert [r.item_id for r in got] == [f"F{k:03d}" for k in range(1, 8)] and got[-1].spent == 10 + 1000 + 2000 + 1250 + 600 + 600
    both = rows.join(budget.modes(rows, [F.col("path")]), "path").withColumns({"n_symbols": F.lit(0), "outline_tokens": F.lit(20)})
    end = {r.path: (r.content_mode, r.actual) for r in budget.settle(both, [F.col("path")], 9_000).collect()}
    assert end["p4"] == ("full", 8010) and end["p6"] == ("outline", 8050) and end["p7"] == ("tree", 8050)


def test_tokens(spark):
    one = spark.range(1).select(T.tokens(F.lit("hello world")).alias("a"), T.tokens(F.lit("hello world"), "chars", 2).alias("b"), T.tokens(F.lit("hello world"), "chars", 5).alias("c"), T.tokens(F.lit("")).alias("d"), T.tokens(F.lit(None).cast("string")).alias("e"), T.tokens(F.lit("x")).alias("f")).first()
    assert tuple(one) == (2, 5, 2, 0, 0, 1)


def test_snapshot(spark, tmp_path):
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("d", 1, 1)], "path string, mtime_ns long, size_bytes long")
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 1)], "path string, mtime_ns long, size_bytes long")
    assert {tuple(r) for r in snapshot.changed(now, old).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "src string, dst string")
    c = snapshot.changed(now, old)
    assert [tuple(r) for r in snapshot.survivors(e, c).collect()] == [("a", "a")] and snapshot.to_rebuild(e, c).count() == 2
    to = "file://" + str(tmp_path)
    assert snapshot.read(spark, to, "h") is None
    snapshot.write(to, now, e, "h")
    files, edges = snapshot.read(spark, to, "h")
    assert files.count() == 3 and edges.count() == 3 and snapshot.read(spark, to, "other") is None
