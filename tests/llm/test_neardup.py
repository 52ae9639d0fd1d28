import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxgraph.llm import neardup
from ctxgraph.llm.components import components


def brute(rows):
    """class and number of linked nodes of each (doc_id, text), by comparing all pairs of signatures."""
    rows = [(i, t) for i, t in rows]
    sig, n = neardup.signatures(pa.array([t for _, t in rows], pa.string()))
    nodes = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        if t is not None and i is not None:
            nodes[(sig[k].tobytes(), int(n[k])) if n[k] else ("text", t)].append(k)
    keys = sorted(nodes, key=lambda x: min(rows[k][0] for k in nodes[x]))
    ids = [min(rows[k][0] for k in nodes[x]) for x in keys]
    first = [nodes[x][0] for x in keys]
    parent, links = list(range(len(keys))), [0] * len(keys)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            i, j = first[a], first[b]
            if n[i] and n[j] and neardup._linked(sig[i], n[i], sig[j], n[j]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for a, x in enumerate(keys):
        for k in nodes[x]:
            out[rows[k][0]] = (ids[root(a)], links[a])
    return out


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()}
    assert got == want
    assert sum(a != b for a, (b, _) in want.items()) > 3


def test_edge_cases(spark):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, base), (2, base), (3, base.upper() + "!"), (4, base.replace("w7 ", "x ")), (5, ""), (6, ""), (7, None), (8, "..."), (9, "other words here"), (None, base), (10, "z " * 300_000), (11, "z z")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, sig string, class_id long")
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in neardup.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert got[1] == got[2] == got[3] == got[4] == (1, 1, 4)
    assert got[5][0] == got[6][0] == 5 and got[7] == (7, 0, 1) and got[8] == (8, 0, 1) and got[9] == (9, 0, 1)
    assert got[None][0] is None and got[10][0] == got[11][0] == 10
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_hot_group_lists_few_edges(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(200)] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == {i: c for i, (c, _) in want.items()}
    near = sum(abs(r.n_links - want[r.doc_id][1]) for r in got) / sum(n for _, n in want.values())
    assert near < 0.01
    sig, n = neardup.signatures(pa.array([t for _, t in rows]))
    assert np.mean([len(neardup.listed(np.arange(600), sig, n)) for _ in range(1)]) < 60


def test_audit_counts_nodes_not_links(spark):
    hot, pairs = {i: 4_999 for i in range(340)}, {i: 1 for i in range(340, 442)}
    assert neardup.recall(hot | pairs, hot) == 0 and neardup.recall(hot | pairs, hot | pairs) == 1
    rng = random.Random(7)
    texts, base = [], [f"w{k}" for k in range(100)]
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = f"v{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    for i in range(120):
        w = [f"p{rng.randrange(10**9)}" for _ in range(100)]
        texts += [" ".join(w), " ".join([*w[:5], f"z{i}", *w[6:]])]
    rows = list(enumerate(texts))
    want = brute(rows)
    # a beam so narrow that it alone loses pairs beside the hot group
    got = {r.doc_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), beam=2).collect()}
    pairs = [i for i in range(400, 640) if want[i][1]]
    assert len(pairs) > 200 and sum(min(got[i], want[i][1]) / want[i][1] for i in pairs) >= 0.97 * len(pairs)


def test_links_found_from_one_side_are_kept():
    class Missing(neardup.Graph):
        """Its searches of the last node find nothing."""

        def near_all(self, q, width, start=None):
            return [None if k == len(q) - 1 else x for k, x in enumerate(super().near_all(q, width, start))]

    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"v{k}", *base[k + 1 :]]) for k in range(9)]
    sig, n = neardup.signatures(pa.array(texts))
    nodes = np.arange(9)
    assert all(neardup._linked(sig, n, sig[k], n[k]).all() for k in nodes)
    a, b, links = neardup.shard_edges(Missing(sig), nodes, sig, n, (nodes, sig, n), neardup.BEAM)
    joined = {0}
    for _ in nodes:
        joined |= {x for e in zip(a, b) if joined & {*e} for x in e}
    assert joined == {*range(9)} and sum(links) == 8 * 8 and len(a) < 3 * 9


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_representatives(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (1, base), (2, base + " x"), (3, "lone words"), (4, None), (4, None), (None, "no id"), (5, "")]
    docs = spark.createDataFrame([("a", i, t) for i, t in rows], "lang string, doc_id long, text string")
    kept = neardup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "no id"), (1, base), (3, "lone words"), (4, ""), (5, "")]
    clash = docs.withColumns({c: F.lit(7) for c in ("class_id", "n_links", "sig", "node", "digest")})
    assert neardup.representatives(clash).columns == clash.columns and neardup.representatives(clash).count() == 5
    assert neardup.representatives(docs.limit(0)).count() == 0
