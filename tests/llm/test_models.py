"""Search, classifiers and decontamination: against brute force and by accuracy on rows held out."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ctxgraph.llm import ann, decontam, quality, textvec, toxicity


def test_word_hashes():
    import re

    texts = ["Hello, wörld! it's 2x", "", None, "«quoted» “words” — x", "a" * 50, "x y " * 10, "HELLO wörld"]
    texts = texts + ["zz " * 2_000_000]
    runs = list(textvec.words(pa.array(texts, pa.string()), False))
    counts = np.concatenate([r[1] for r in runs])
    assert counts.tolist() == [len(re.findall(r"\w+", t or "")) for t in texts]
    h = np.concatenate([r[2] for r in runs])
    assert h[0] == h[-2_000_002] and len(set(h[:5].tolist())) == 5


def test_shingles():
    h = np.array([1, 2, 3, 4, 5, 6], textvec.U)
    s, n = textvec.shingles(h, np.array([4, 0, 2]), 3)
    assert n.tolist() == [2, 0, 1] and len(s) == 3
    assert s[0] == textvec.shingles(h[:3], np.array([3]), 3)[0][0]


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1_500, 24))
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(2_000, None, 0), (2_001, [0.0] * 24, 0), (2_002, [float("nan")] + [1.0] * 23, 0), (2_003, [1.0], 0), (2_004, [1.0] * 24, 0), (2_005, [1.0] * 24, 0), (2_006, [2.0] * 24, 0), (None, [1.0] * 24, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = {}
    for r in ann.search(v, v.where("vec_id % 50 = 0 OR vec_id > 1999")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([*range(1_500), 2_004, 2_005, 2_006])
    y = np.vstack((x, np.ones((2, 24)), 2 * np.ones((1, 24))))
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    hit = n = 0
    for q in sorted(got):
        at = int(np.flatnonzero(ids == q)[0])
        s = u @ u[at]
        s[at] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 5 and [k for k, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] and q not in found
        for _, i, score in got[q]:
            assert abs(score - s[int(np.flatnonzero(ids == i)[0])]) < 1e-12
        hit += len(set(found) & set(best.tolist()))
        n += 5
    assert set(got) == {*range(0, 1_500, 50), 2_004, 2_005, 2_006} and hit / n >= 0.9
    assert [i for _, i, _ in sorted(got[2_004])][:2] == [2_005, 2_006]


def test_ann_few(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_ann_repeated_rows(spark):
    """Every row but the query's own, told by row and not by id; lengths apart; each query row answered."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (7, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (150, [1.0, 2.0, 2.0]), (200, [4.0])]
    rows += [(int(i), rng.standard_normal(2).tolist()) for i in rng.integers(2, 40, 60)] + [(8, [-1.0, 0.0]), (8, None), (9, [])]
    v = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "vec_id long, embedding array<double>, q string, own int").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(v, v.where("vec_id % 50 = 0")).collect())
    want = []
    for n, (i, x) in enumerate(rows):
        if i % 50 == 0 and x:
            cos = lambda y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
            near = sorted((-round(cos(y), 12), j) for m, (j, y) in enumerate(rows) if m != n and y and len(y) == len(x))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)]
    want.sort()
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-11)
    assert sum(r[0] == 50 for r in got) == 15 and any(r[0] == r[2] for r in got)


def test_hadamard():
    for width in (1, 2, 16, 64, 128):
        h = np.ones((1, 1), np.float32)
        while len(h) < width:
            h = np.block([[h, h], [h, -h]])
        x = np.random.default_rng(width).standard_normal((3, width)).astype(np.float32)
        assert np.allclose(np.sort(ann.hadamard(x)), np.sort(x @ h), atol=1e-4)


def test_ann_candidates():
    """Buckets that are probed are those whose axes reach far enough, and no others."""
    rng = np.random.default_rng(9)
    x = ann.unit(rng.standard_normal((3_000, 24)))
    r = ann.Rotations(24, 5)
    far = np.full((40, len(x)), -np.inf)
    for t in range(5):
        axes = r.axes(x, t)
        far = np.maximum(far, sum(y[:, a] for y, a in zip(r.signed(x[:40], t), axes)))
    mark = ann.candidates(r, ann.buckets(r, x), x[:40], len(x), 1.1)
    sure = np.abs(far - 1.1) > 1e-4
    assert (mark == (far >= 1.1))[sure].all() and 0.001 < mark.mean() < 0.9 and mark[np.arange(40), np.arange(40)].all()


def test_toxicity(spark):
    rng = random.Random(1)
    clean = ["".join(rng.choices("aeioust", k=rng.randint(2, 6))) for _ in range(300)]
    bad = ["zorkling", "zorkment", "grubbish"]
    rows = []
    for i in range(500):
        w = rng.choices(clean, k=rng.randint(5, 300))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(1, len(w) // 60)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(900, None, None), (901, "", None), (902, "!!!", None), (903, " ".join(clean * 200), None), (904, " ".join([*clean * 100, "zorkling", *clean * 100]), None)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, toxicity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None] + [(3, None), (4, 7)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, net).collect()}
    held = [(i, y) for i, _, y in rows if y is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (y == 1) for i, y in held) / len(held) > 0.95
    assert got[900] == got[901] == got[902] < 0.5 and got[903] < 0.5 <= got[904]
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).where("toxicity <> 1").isEmpty()
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("toxicity <> 0").isEmpty()


def naive_score(net: toxicity.Network, text: str | None) -> float:
    """A text's score by loops over its windows, words, bytes and steps, from the parameters alone."""
    import re

    whole, prime = 1 << 64, 0x9E3779B97F4A7C15 | 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    def vector(word):
        raw = word.encode()
        own = mix(sum((b + 1) * pow(prime, i, whole) for i, b in enumerate(raw)) % whole) % toxicity.WORDS
        padded = b"\x01" + raw + b"\x02" * 4
        grams = []
        for k in range(max(1, len(raw) - 1)):
            total = 0
            for b in padded[k : k + 4]:
                total = (total * 257 + b + 1) % whole
            grams.append(mix(total) % toxicity.GRAMS)
        return np.concatenate((net.p["Ew"][own], sum(net.p["Ec"][g] for g in grams) / np.sqrt(len(grams)))).astype(float)

    s = lambda x: 1 / (1 + np.exp(-x))
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    words = [vector(w) for w in re.findall(r"\w+", (text or "").lower())]
    begins = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    logits = []
    for begin in begins:
        window = words[begin : begin + toxicity.WINDOW]
        if not window:
            return 0.0
        states = np.zeros((len(window), 2 * h))
        for d, name in enumerate("fb"):
            state = np.zeros(h)
            for t in range(len(window)) if d == 0 else reversed(range(len(window))):
                gx, gh = window[t] @ p["W" + name] + p["b" + name], state @ p["U" + name]
                z, r = s(gx[:h] + gh[:h]), s(gx[h : 2 * h] + gh[h : 2 * h])
                new = np.tanh(gx[2 * h :] + r * (gh[2 * h :] + p["c" + name]))
                state = (1 - z) * new + z * state
                states[t, d * h : d * h + h] = state
        e = np.exp(np.tanh(states @ p["Wa"] + p["ba"]) @ p["va"])
        logits.append(float((e / e.sum()) @ states @ p["wo"] + p["bo"][0]))
    return float(s(max(logits) - net.shift))


def test_scores_against_a_naive_forward_pass(spark):
    rng = random.Random(12)
    net = toxicity.Network(np.random.default_rng(3))
    net.shift = 0.2
    words = ["a", "is", "größe", "word_9", "toxicword", "x" * 40, "mid"]
    texts = [None, "", "?!", "one", *(" ".join(rng.choices(words, k=n)) for n in (2, 63, 64, 65, 112, 113, 160, 700)), "one"]
    docs = spark.createDataFrame([(i, t, 1, "l") for i, t in enumerate(texts)], "doc_id long, text string, toxicity int, score string")
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert len(got) == len(texts) and all(r.score == "l" for r in got.values())
    for i, t in enumerate(texts):
        assert got[i].toxicity == pytest.approx(naive_score(net, t), abs=2e-5), i
    assert toxicity.score(docs.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs.limit(0), labels) == 0.0 and toxicity.fit(docs, labels.limit(0)) == 0.0


def test_window_maxima_at_every_size():
    rng = np.random.default_rng(5)
    begin = np.arange(0, 450_000 * 48, 48)  # over 400 000 windows of 64 every 48
    size = rng.integers(0, 65, len(begin))
    lead = rng.normal(size=int(begin[-1]) + 65).astype(np.float32)
    got = toxicity.window_max(lead, begin, size)
    want = np.array([lead[b : b + s].max() if s > 0 else -9 for b, s in zip(begin, size)], np.float32)
    assert (got == want).all()
    assert (toxicity.window_max(lead[:65], begin[:1], np.array([0])) == -9).all() and len(toxicity.window_max(lead, begin[:0], size[:0])) == 0


def test_gradients():
    """The backward pass against differences."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    for k in ("Ew", "Ec"):
        net.p.pop(k)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = rng.standard_normal((9, toxicity.DIM_WORD + toxicity.DIM_GRAM))
    idx, size, y, w = rng.integers(0, 9, (3, 6)), np.array([6, 4, 1]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.7])

    def loss():
        z = net.run(x, idx, size).astype(float)
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum())

    net.p |= {"Ew": np.zeros((1, 4)), "Ec": np.zeros((1, 8))}
    g = net.gradients(x, idx, size, y, w)
    for name in ("Wf", "Ub", "cf", "Wa", "va", "wo", "bb", "x"):
        v = x if name == "x" else net.p[name]
        at = tuple(rng.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up = loss()
        v[at] = old - 1e-3
        down = loss()
        v[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3, rel=0.05), name


def test_quality(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioust", k=5)) for _ in range(400)]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.choices(words[:4], k=80) if bad else rng.choices(words, k=80)
        rows.append((i, " ".join(w), f"h{i % 3}" if not bad else "h3", ["p", None][i % 2], int(not bad)))
    rows += [(900, None, None, None, None), (901, "", "h0", "p", None), (902, "x " * 100_000, "h9", "q", None)]
    docs = spark.createDataFrame([(a, b, c, d) for a, b, c, d, _ in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[4] is not None], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.assess(docs, labels, docs.host, docs.path).collect()}
    assert len(out) == len(rows)
    held = [(r[0], r[4]) for r in rows if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((out[i].score >= 0.5) == (y == 1) for i, y in held) / len(held) > 0.95
    assert out[0].host_prior < out[1].host_prior
    whole = sum(1 / (1 + np.exp(-r.evidence)) for r in out.values()) / len(out)
    assert abs(out[902].host_prior - whole) < abs(out[0].host_prior - whole)  # a sparse site stays near the whole
    assert quality.assess(docs, labels.limit(0), docs.host, docs.path).where("evidence <> 0").isEmpty()
    assert quality.assess(docs.limit(0), labels, docs.host, docs.path).count() == 0


def test_quality_posteriors_against_plain_sums(spark):
    """Host and path posteriors and scores from the evidence alone, by loops; with nulls, ties, repeated rows and clashing
    columns."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["good", "fine", "word", "x1", "!!"], k=rng.randint(0, 40))), rng.choice(["a", "b", "b", "b", None]), rng.choice(["p", "q", None])) for i in range(160)]
    rows += [rows[5]] * 3 + [(500, "lone", "c", "p"), (501, None, "c", "r"), (None, "no id", "a", "p"), (502, "big " * 50_000, "d", "p")]
    docs = spark.createDataFrame([(*r, "k", 2) for r in rows], "doc_id long, text string, host string, path string, evidence string, n int")
    labels = spark.createDataFrame([(i, int("good" in t)) for i, t, *_ in rows[:120]], "doc_id long, quality int")
    out = quality.assess(docs, labels, docs.host, docs.path).collect()
    assert len(out) == len(rows)
    known = {i: y for i, y in ((r.doc_id, r.quality) for r in labels.collect()) if zlib.crc32(str(i).encode()) % 5}
    base = (sum(known.values()) + 1) / (len(known) + 2)
    center = np.log(base / (1 - base))
    groups, hosts = {}, {}
    for r in out:
        p = round(float(1 / (1 + np.exp(-(r.evidence + center)))), 9)
        groups.setdefault((r.host, r.path), []).append(p)
        hosts.setdefault(r.host, []).append(p)

    def strength(parts):
        parts = [(len(x), sum(x) / len(x), p) for x, p in parts if len(x) > 1]
        n = sum(k for k, *_ in parts)
        within = sum(k * p * (1 - p) for k, _, p in parts) / n
        between = sum(k * (m - p) ** 2 for k, m, p in parts) / n - within * len(parts) / n
        return min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6

    every = [p for x in hosts.values() for p in x]
    mean = sum(every) / len(every)
    s = strength([(x, mean) for x in hosts.values()])
    host = {k: (sum(x) + s * mean) / (len(x) + s) for k, x in hosts.items()}
    t = strength([(x, host[k[0]]) for k, x in groups.items()])
    path = {k: (sum(x) + t * host[k[0]]) / (len(x) + t) for k, x in groups.items()}
    for r in out:
        q = path[r.host, r.path]
        score = 1 / (1 + np.exp(-(r.evidence + center + quality.TRUST * (np.log(q / (1 - q)) - center))))
        assert (r.host_prior, r.path_prior, r.score) == pytest.approx((host[r.host], q, score), rel=1e-6)


def brute(doc: str | None, item: str | None) -> float:
    """Best share of an item's runs of words in the windows of a document."""
    import re

    grams = lambda t: [tuple(w[i : i + decontam.K]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - decontam.K + 1)]
    own = re.findall(r"\w+", (item or "").lower())
    if len(own) < decontam.MIN_WORDS:
        words = re.findall(r"\w+", (doc or "").lower())
        return float(bool(own) and any(words[k : k + len(own)] == own for k in range(len(words))))
    want, have = set(grams(item)), grams(doc)
    u = 1 << (len(grams(item)) - 1).bit_length()
    return max((len(want & set(have[k : k + 2 * u])) / len(want) for k in range(0, max(1, len(have)), u)), default=0.0)


def test_decontamination(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3_000)]
    items = {i: " ".join(rng.choices(words, k=n)) for i, n in enumerate([20, 25, 40, 70, 300, 9, 5])}
    items[7] = items[0]
    items[8] = None
    lines = " ".join(rng.choices(words, k=10))
    items |= {9: "lone two", 10: "Single", 11: "!!", 12: "", 13: " ".join(rng.choices(words, k=30) + [lines] * 100 + rng.choices(words, k=30))}
    docs = []
    for k in range(60):
        w = rng.choices(words, k=rng.choice([10, 200, 5_000]))
        if k % 3 == 0:
            own = items[k % 7].upper().split()
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = "changed"
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((k, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, items[5]), (103, items[0] + " " + items[0]), (104, "the LONE, two"), (105, "two lone"), (106, "single"), (107, "w1 " * 3_000 + items[13] + " w2" * 3_000), (108, items[6])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, leaks string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, x.item_id): x.containment for r in decontam.find(d, b).collect() for x in r.leaks}
    want = {(i, j): s for i, t in docs for j, it in items.items() if (s := brute(t, it)) >= decontam.THRESHOLD - 1e-9}
    assert got == pytest.approx(want) and len(want) > 15 and {(103, 7), (104, 9), (106, 10), (107, 13), (108, 6)} <= set(got) and (105, 9) not in got
    assert got[107, 13] == 1
    small = decontam.BLOCK
    try:
        decontam.blocks.__defaults__ = (50,)
        again = {(r.doc_id, x.item_id) for r in decontam.find(d, b).collect() for x in r.leaks}
    finally:
        decontam.blocks.__defaults__ = (small,)
    assert again == set(want)
    d.write.parquet(f"{tmp_path}/documents.parquet"), b.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert {(i, j): x for i, j, x in con.execute(decontam.ORACLE).fetchall()} == {(r.doc_id, r.item_id): r.containment for r in decontam.op4_decontamination(spark, str(tmp_path)).collect()}
    assert decontam.find(d, b.limit(0)).where("size(leaks) > 0").isEmpty() and decontam.find(d.limit(0), b).count() == 0
