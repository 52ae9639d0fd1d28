"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input: the words of the whole text (``textvec``), each as the concatenation of an embedding of the word's hash bucket and
the mean of embeddings of its byte 4-grams (with word boundaries). A text is cut into overlapping windows of ``WINDOW``
words that start every ``STRIDE`` words and cover it to the end; each window runs through a gated recurrent unit in both
directions, attention pools the states, a logistic output gives the window's score, and the text's score is the largest.

Training: documents with a label whose crc32(doc_id as text) mod 5 is not 0, at most ``FIT_DOCS`` of each class (those of the
smallest hash of the id) of at most ``FIT_BYTES`` bytes, so that it takes the same time at every size. Embeddings start
from smoothed log odds of the buckets; each document then learns from its most suspicious windows, chosen anew twice.
The decision boundary is set on the training documents. Labels, language, source and id are never inputs of a score.

Null and empty texts, and texts without words, score 0: nothing stands in them. Without labelled rows of both classes every
score is the share of toxic rows (0 without any). Repeated rows get the same score; rows are kept one for one. Labels
other than 0 and 1 are ignored; of several labels of one document the largest counts. Texts of any length are scored whole.
A column named as the result is replaced; others pass through.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from . import textvec
from .bpe import _q, portions
from .textvec import U

WINDOW, STRIDE, HIDDEN, ATTEND = 64, 48, 12, 8
WORDS = GRAMS = 1 << 14
DIM_WORD, DIM_GRAM = 4, 8
FIT_DOCS, FIT_BYTES, EPOCHS = 1_500, 1 << 15, 9
f32 = np.float32


def vocabulary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray):
    """Distinct words: their buckets, gram buckets with the number of grams of each, and the word of each place."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    a, size = starts[first], (ends - starts)[first]
    n = np.maximum(size - 1, 1)  # 4-grams of the word between two boundary bytes
    of = np.repeat(np.arange(len(first)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) - 1  # from -1: the boundary
    total = np.zeros(len(of), U)
    low, length = a[of], size[of]
    for i in range(4):
        k = at + i
        inside = (k >= 0) & (k < length)
        byte = np.where(inside, data[np.where(inside, low + k, 0)], 1 if i == 0 else 2).astype(U)
        total = total * U(257) + byte + U(1)
    return (h[first] % U(WORDS)).astype(np.int64), (textvec.mix(total) % U(GRAMS)).astype(np.int64), n, inverse


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of so many words: row, first word and number of words of every window."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = k * STRIDE
    return row, (np.cumsum(counts) - counts)[row] + begin, np.minimum(counts[row] - begin, WINDOW)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + f32(0.5)


class Network:
    """Parameters by name in ``p``; ``inverse`` indexes below address rows of a table of word vectors."""

    def __init__(self, rng: np.random.Generator):
        d, h = DIM_WORD + DIM_GRAM, HIDDEN
        g = lambda *s, k=1.0: (rng.standard_normal(s) * k / np.sqrt(s[0])).astype(f32)
        self.p = {"Ew": g(WORDS, DIM_WORD, k=3), "Ec": g(GRAMS, DIM_GRAM, k=3), "Wa": g(2 * h, ATTEND), "ba": np.zeros(ATTEND, f32), "va": g(ATTEND), "wo": g(2 * h), "bo": np.zeros(1, f32)}
        for s in "fb":
            self.p |= {"W" + s: g(d, 3 * h, k=1.5), "b" + s: np.zeros(3 * h, f32), "U" + s: g(h, 3 * h), "c" + s: np.zeros(h, f32)}
        self.shift = 0.0

    def vectors(self, word, gram, n):
        sums = np.add.reduceat(self.p["Ec"][gram], np.cumsum(n) - n, axis=0)
        return np.concatenate((self.p["Ew"][word], sums / np.sqrt(n)[:, None].astype(f32)), axis=1)

    def run(self, x: np.ndarray, idx: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: ``idx`` (B, T) rows of ``x``; places from ``size`` on don't count. ``keep`` gets what the
        backward pass needs."""
        p, h, steps = self.p, HIDDEN, idx.shape[1]
        mask = np.arange(steps)[None, :] < size[:, None]
        states = np.empty((len(idx), steps, 2 * h), f32)
        for k, s in enumerate("fb"):
            proj = x @ p["W" + s] + p["b" + s]
            state = np.zeros((len(idx), h), f32)
            for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
                gx, gh = proj[idx[:, t]], state @ p["U" + s]
                zr = sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                un = gh[:, 2 * h :] + p["c" + s]
                new = np.tanh(gx[:, 2 * h :] + r * un)
                m = mask[:, t, None]
                after = (new + z * (state - new)) * m
                if keep is not None:
                    keep.append((s, t, state, z, r, un, new, m))
                states[:, t, k * h : k * h + h] = state = after
        a = np.tanh(states @ p["Wa"] + p["ba"])
        e = np.where(mask, a @ p["va"], f32(-1e9))
        e = np.exp(e - e.max(1, keepdims=True))
        w = e / e.sum(1, keepdims=True)
        pooled = (w[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep.append((states, a, w, pooled))
        return pooled @ p["wo"] + p["bo"][0]

    def gradients(self, x, idx, size, y, weight):
        """Of the weighted logistic loss, by parameter; those of the word vectors under "x"."""
        p, h, keep = self.p, HIDDEN, []
        logit = self.run(x, idx, size, keep)
        states, a, w, pooled = keep.pop()
        d = ((sigmoid(logit) - y) * weight)[:, None].astype(f32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("Ew", "Ec")}
        g["wo"], g["bo"] = (pooled * d).sum(0), d.sum(0)
        dp = d * p["wo"]
        dw = (states @ dp[:, :, None])[:, :, 0]
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["va"] = np.einsum("bta,bt->a", a, de)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["ba"], g["Wa"] = da.sum((0, 1)), np.tensordot(states, da, ((0, 1), (0, 1)))
        ds = da @ p["Wa"].T + w[:, :, None] * dp[:, None, :]
        dx = np.zeros_like(x)
        flow = {"f": np.zeros((len(idx), h), f32), "b": np.zeros((len(idx), h), f32)}
        proj = {s: np.zeros((len(x), 3 * h), f32) for s in "fb"}
        for s, t, state, z, r, un, new, m in reversed(keep):
            k = 0 if s == "f" else h
            dh = (flow[s] + ds[:, t, k : k + h]) * m
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (state - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dgh = np.concatenate((dz, dr, dn * r), axis=1)
            g["U" + s] += state.T @ dgh
            g["c" + s] += (dn * r).sum(0)
            flow[s] = dh * z + dgh @ p["U" + s].T
            np.add.at(proj[s], idx[:, t], np.concatenate((dz, dr, dn), axis=1))
        for s in "fb":
            g["W" + s], g["b" + s] = x.T @ proj[s], proj[s].sum(0)
            dx += proj[s] @ p["W" + s].T
        g["x"] = dx
        return g


def window_max(lead: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The largest lead in each window, -9 in an empty one; windows may overlap."""
    if len(begin) == 0:
        return np.zeros(0, lead.dtype)
    ends = np.stack((begin, begin + size), 1).ravel()
    return np.where(size > 0, np.maximum.reduceat(np.append(lead, lead.dtype.type(-9)), ends)[::2], lead.dtype.type(-9))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network | float:
    """A network, or the share of toxic rows where one class is missing."""
    if len({*labels}) < 2:
        return float(labels[0]) if labels else 0.0
    rng = np.random.default_rng(seed)
    y = np.array(labels, f32)
    # smoothed log odds of a bucket's presence in toxic documents are counted run by run, as no document is in two
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)
    seen = {"Ew": np.zeros((2, WORDS)), "Ec": np.zeros((2, GRAMS))}

    def see(name: str, buckets: np.ndarray, docs: np.ndarray) -> None:
        pairs = np.unique(docs * WORDS + buckets)
        for c in (0, 1):
            seen[name][c] += np.bincount(pairs[y[pairs // WORDS] == c] % WORDS, minlength=WORDS)

    word, gram, n, place, counts, known = [], [], [], [], [], 0
    for first, c, h, data, a, z in textvec.words(pa.array(texts, pa.string()), True):
        w, g, k, inverse = vocabulary(data, a, z, h) if len(h) else (np.zeros(0, np.int64),) * 4
        if len(h):
            # a word's grams count once for each document that has the word
            own = np.unique(textvec.segments(c) * len(w) + inverse)
            docs, ids = first + own // len(w), own % len(w)
            see("Ew", w[ids], docs)
            begins = np.cumsum(k) - k
            flat = np.repeat(begins[ids], k[ids]) + np.arange(int(k[ids].sum())) - np.repeat(np.cumsum(k[ids]) - k[ids], k[ids])
            see("Ec", g[flat], np.repeat(docs, k[ids]))
        place.append((inverse + known).astype(np.int32))
        known += len(w)
        word.append(w.astype(np.int32)), gram.append(g.astype(np.int32)), n.append(k), counts.append(c)
    word, gram, n, place, counts = map(np.concatenate, (word, gram, n, place, counts))
    word, gram, n = np.append(word, 0), np.append(gram, 0), np.append(n, 1)  # for rows without words
    gram_first = np.cumsum(n) - n
    net = Network(rng)
    for name, (clean, toxic) in seen.items():
        lift = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
        net.p[name][:, 0] = np.clip(lift, -3, 5) * np.minimum(1, (clean + toxic) / 4) / 2
    row, begin, size = windows(counts)
    x0 = net.vectors(word, gram, n)
    lead = (x0[:, 0] + x0[:, DIM_WORD])[np.append(place, len(word) - 1)]
    pad = len(word) - 1
    places = np.append(place, pad)

    def index(which):
        at = begin[which][:, None] + np.arange(WINDOW)
        return np.where(np.arange(WINDOW) < size[which][:, None], places[np.minimum(at, len(place))], pad)

    def logits(which, x):
        return np.concatenate([net.run(x, index(which[k : k + 4096]), size[which[k : k + 4096]]) for k in range(0, len(which), 4096)] or [np.zeros(0, f32)])

    def choose(score, more):
        """The highest windows of each document."""
        order = np.lexsort((-score, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        return order[rank < 1 + more * (y[row[order]] == 0)]

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    picked = choose(window_max(lead, begin, size), 1)
    for epoch in range(EPOCHS):
        if epoch in (EPOCHS // 3, 2 * EPOCHS // 3):
            picked = choose(logits(np.arange(len(row)), net.vectors(word, gram, n)), 1)
        extra = rng.choice(np.flatnonzero(y[row] == 0), min(len(y), int((y[row] == 0).sum())), replace=False)
        use = rng.permutation(np.unique(np.concatenate((picked, extra))))
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.001
        balance = float((y[row[use]] == 0).sum() / max(1, (y[row[use]] == 1).sum())) ** 0.5
        for k in range(0, len(use), 128):
            part = use[k : k + 128]
            idx = index(part)
            own, local = np.unique(idx, return_inverse=True)
            gn = n[own]
            flat = gram[np.repeat(gram_first[own], gn) + np.arange(int(gn.sum())) - np.repeat(np.cumsum(gn) - gn, gn)]
            x = net.vectors(word[own], flat, gn)
            target = y[row[part]]
            weight = np.where(target == 1, balance, 1).astype(f32) / len(part)
            g = net.gradients(x, local.reshape(idx.shape), size[part], target, weight)
            dx = g.pop("x")
            g["Ew"], g["Ec"] = np.zeros_like(net.p["Ew"]), np.zeros_like(net.p["Ec"])
            np.add.at(g["Ew"], word[own], dx[:, :DIM_WORD])
            np.add.at(g["Ec"], flat, np.repeat(dx[:, DIM_WORD:] / np.sqrt(gn)[:, None].astype(f32), gn, axis=0))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            step += 1
            for name, v in g.items():
                v = v * f32(scale)
                m1, m2 = moments[name]
                m1 *= f32(0.9)
                m1 += f32(0.1) * v
                m2 *= f32(0.99)
                m2 += f32(0.01) * v * v
                net.p[name] -= f32(rate) * (m1 / f32(1 - 0.9**step)) / (np.sqrt(m2 / f32(1 - 0.99**step)) + f32(1e-6))
    # the boundary: where the training documents are told apart best, in the middle of the gap
    score = np.full(len(y), -30.0)
    np.maximum.at(score, row, logits(np.arange(len(row)), net.vectors(word, gram, n)))
    order = np.argsort(score)
    errors = np.concatenate(([total[0]], total[0] + np.cumsum(np.where(y[order] == 1, 1, -1))))
    ok = np.flatnonzero(errors == errors.min())
    cuts = np.concatenate(([score[order[0]] - 2], (score[order][1:] + score[order][:-1]) / 2, [score[order[-1]] + 2]))
    net.shift = float(cuts[ok[len(ok) // 2]])
    return net


def score_column(net: Network | float, column: pa.Array) -> np.ndarray:
    """Scores of whole texts in double precision, between 0 and 1."""
    if not isinstance(net, Network):
        return np.full(len(column), float(net))
    out = np.full(len(column), -np.inf)
    for first, counts, h, data, a, z in textvec.words(column, True):
        if len(h):
            word, gram, n, place = vocabulary(data, a, z, h)
            x = net.vectors(word, gram, n)
        else:
            x, place = np.zeros((0, DIM_WORD + DIM_GRAM), f32), np.zeros(0, np.int64)
        x = np.vstack((x, np.zeros((1, x.shape[1]), f32)))
        places = np.append(place, len(x) - 1)
        row, begin, size = windows(counts)
        for k in range(0, len(row), 4096):
            s = slice(k, k + 4096)
            at = begin[s][:, None] + np.arange(WINDOW)
            idx = np.where(np.arange(WINDOW) < size[s][:, None], places[np.minimum(at, len(place))], len(x) - 1)
            np.maximum.at(out, first + row[s], np.where(size[s] > 0, net.run(x, idx, size[s]).astype(float), -np.inf))
    return 1 / (1 + np.exp(-np.clip(out - net.shift, -700, 700)))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS) -> Network | float:
    """Train on a bounded sample of the labelled documents of the training folds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    turn = F.xxhash64(F.col("doc_id"), F.lit(11))
    picked = known.where("y = 1").orderBy(turn, "doc_id").limit(fit_docs).unionByName(known.where("y = 0").orderBy(turn, "doc_id").limit(fit_docs))
    rows = (
        docs.select("doc_id", _q(text).alias("text"))
        .where((F.octet_length("text") <= FIT_BYTES) & ~held_out("doc_id"))
        .join(F.broadcast(picked), "doc_id")  # at most 2 * fit_docs rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .orderBy(turn, "doc_id").collect()
    )
    return train([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, net: Network | float, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out`` (double, never null). No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*map(_q, kept)).withColumn(out, F.lit(0.0)).schema
    model = spark.sparkContext.broadcast(pickle.dumps(net))  # about 1 MB, whatever the data

    def run(batches):
        own = pickle.loads(model.value)
        for b in batches:
            for part in portions(b, text, 8_000_000):
                s = pa.array(score_column(own, part.column(text)), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [s], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
