"""Graph operators against plain Python on random graphs, and hand-made cases."""

import heapq
import random

import pytest

from ctxgraph.operators import graph, relations


def frame(spark, rows):
    return spark.createDataFrame([(a, b, k, w, c) for a, b, k, w, c in rows], "src string, dst string, kind string, weight double, confidence double")


def simple(spark, pairs):
    return frame(spark, [(a, b, "import", 1.0, 0.98) for a, b in pairs])


def random_edges(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", rng.choice(["import", "env_key"]), rng.choice([0.4, 0.7, 1.0]), rng.choice([0.5, 0.9])) for _ in range(m)]


def reachable(pairs, start):
    seen, stack = set(), [start]
    while stack:
        x = stack.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = random_edges(seed)
    e = frame(spark, rows)
    pairs = {(a, b) for a, b, *_ in rows}
    nodes = {x for p in pairs for x in p}
    reach = {x: reachable(pairs, x) for x in nodes}
    scc = {x: min({x} | {y for y in reach[x] if x in reach[y]}) for x in nodes}
    assert {r.node: r.scc for r in graph.scc(e).collect()} == scc
    both = pairs | {(b, a) for a, b in pairs}
    assert {r.node: r.component for r in graph.components(e).collect()} == {x: min({x} | reachable(both, x)) for x in nodes}
    layers = {r.node: r.layer for r in graph.topological_layers(e).collect()}
    bad = {x for x in nodes if x in reach[x] or any(x in reach[y] for y in nodes if y in reach[y])}
    last = max(layers.values())
    assert {x for x in nodes if x in bad} == ({x for x, d in layers.items() if d == last} if bad else set())
    assert all(layers[a] < layers[b] for a, b in pairs if b not in bad and a not in bad)
    rank = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6
    for reverse in (False, True):
        got = {(r.seed, r.node): r.strength for r in graph.weighted_walk(e, spark.createDataFrame([("n01",), ("n02",)], "path string"), 3, 2, reverse).collect()}
        assert got == pytest.approx({(s, x): v for s in ("n01", "n02") for x, v in walk(rows, s, 3, 2, reverse).items()})


def walk(rows, start, depth, top, reverse):
    """Best products by a search with a heap."""
    out = {}
    for a, b, k, w, c in rows:
        u, v = (b, a) if reverse else (a, b)
        out.setdefault(u, []).append((-w * c, v, k))
    out = {u: sorted(x)[:top] for u, x in out.items()}
    best, state, queue = {}, {}, [(-1.0, 0, start)]
    while queue:
        s, d, u = heapq.heappop(queue)
        if d == depth:
            continue
        for p, v, k in out.get(u, []):
            x = -s * ((1.0 if d == 0 else 0.88) if k == "import" else -p)
            best[v] = max(best.get(v, 0), x)
            if x > state.get((v, d + 1), 0):
                state[v, d + 1] = x
                heapq.heappush(queue, (-x, d + 1, v))
    best.pop(start, None)
    return best


def test_shapes(spark):
    cyc = simple(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert {(r.scc, r["size"]) for r in graph.cycles(cyc).collect()} == {("a", 3)}
    assert {r.layer for r in graph.topological_layers(cyc).collect()} == {0}
    loop = simple(spark, [("x", "x")])
    assert [tuple(r) for r in graph.cycles(loop).collect()] == [("x", 1)] and graph.degree(loop, False).first().degree == 2
    dag = simple(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert {r.node: r.layer for r in graph.topological_layers(dag).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    rank = {r.node: r["rank"] for r in graph.pagerank(simple(spark, [("a", "b")])).collect()}
    assert rank["b"] > rank["a"]
    none = simple(spark, []).limit(0)
    for f in (graph.scc, graph.cycles, graph.components, graph.topological_layers, graph.pagerank, graph.degree, graph.stats):
        f(none).collect()


def test_top_links(spark):
    e = frame(spark, [("app.py", f"dep_{i:02d}", "import", 1.0, 0.1 * i) for i in range(15)])
    s = spark.createDataFrame([("app.py",)], "path string")
    assert graph.weighted_walk(e, s, 1, 0).count() == 15
    assert {r.node for r in graph.weighted_walk(e, s, 1, 5).collect()} == {f"dep_{i:02d}" for i in range(10, 15)}


def test_distance(spark):
    e = simple(spark, [("a", "b"), ("b", "c"), ("d", "a")])
    f = spark.createDataFrame([(x,) for x in "abcdz"], "path string")
    assert {r.path: r.distance for r in graph.bfs_distance(e, f.where("path = 'a'"), f).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1, "z": 999}


def test_dedup(spark):
    rows = [("a", "b", "import", 0.4, 0.9, "one", 1), ("a", "b", "import", 0.5, 0.1, "two", 2), ("a", "b", "import", 0.5, 0.1, "three", 3)]
    e = spark.createDataFrame([(*r[:6], None, "x", r[6]) for r in rows], "src string, dst string, kind string, weight double, confidence double, evidence string, line int, analyzer string, ord int")
    got = relations.dedup(e, "ord").collect()
    assert [(r.weight, r.confidence, r.evidence) for r in got] == [(0.5, 0.1, "two")]
