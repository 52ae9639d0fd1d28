"""Document quality by hierarchical empirical Bayes over hosts and paths.

Evidence: a logistic classifier over features of the whole text (shares of character classes, word and line statistics,
repetition, and hashed words) gives each document a log-likelihood ratio of being good. It is fitted on at
most ``FIT_DOCS`` labelled documents of each class outside the held-out fold (crc32(doc_id as text) mod 5 = 0), of which
those of over ``FIT_BYTES`` bytes are left out, so that fitting takes bounded memory; every document is assessed whole.

Hierarchy: every document adds its classifier probability to its host and, below that, to its path. Hosts are shrunk
toward the global mean and paths toward their host: with n documents and mean m, the posterior is (n m + s p) / (n + s),
where p is the parent's posterior and the strength s comes from the spread between groups by the method of moments, so that
sparse sites stay near their parent and large ones go by their own documents. The score joins both as odds: the
classifier's likelihood ratio times the prior odds of the path, tempered by ``TRUST``.

A null host or path is a group of its own. Null and empty texts have the features of an empty text. Without labelled rows
of both classes the ratio is 0 and scores are the priors, which then equal the base rate. Rows are kept one for one,
repeated ones each counted in their groups. Columns other than id, text, host and path are left out, whatever their names.

Scale: texts are read once and only (id, host, path, evidence) is kept. Sums are pre-aggregated before the shuffle, hosts
from the sums of their paths. Group posteriors go back by broadcast where the table has at most ``SMALL`` paths;
otherwise the paths with over a thousandth of the rows (fewer than a thousand) are broadcast and the rest joined by key.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, table
from . import textvec
from .bpe import _q, portions
from .textvec import U

FIT_DOCS, FIT_BYTES, HASHED, TRUST, SMALL = 3_000, 1 << 16, 1 << 12, 0.5, 100_000
DENSE = 16


def features(column: pa.Array) -> tuple[np.ndarray, list]:
    """Dense features by text, and (row, bucket, weight) arrays of hashed words."""
    dense = np.zeros((len(column), DENSE))
    sparse = []
    raw = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.maximum(np.diff(offsets), 1)
    for j, chosen in enumerate(([*range(48, 58)], [*range(65, 91)], [10], [ord(c) for c in "#$%&*@^~|<>{}[]=+\\/"], [ord("!"), ord("?")], [ord("."), ord(",")], [32], [*range(128, 256)])):
        is_in = np.zeros(256, bool)
        is_in[chosen] = True
        for lo in range(0, len(raw), 512):  # bounded memory, whatever the texts' lengths
            a, b = offsets[lo], offsets[min(len(raw), lo + 512)]
            marks = np.concatenate(([0], np.cumsum(is_in[data[a:b]], dtype=np.int64)))
            at = offsets[lo : min(len(raw), lo + 512) + 1] - a
            dense[lo : lo + len(at) - 1, j] = np.diff(marks[at])
        dense[:, j] /= size
    dense[:, 8] = np.log1p(np.diff(offsets)) / 10
    for first, counts, h in textvec.words(column):
        n = np.maximum(counts, 1)
        row = textvec.segments(counts)
        own = slice(first, first + len(counts))
        dense[own, 9] = counts / size[own]
        dense[own, 10] = np.log1p(counts) / 10
        if len(h):
            order = np.lexsort((h, row))
            r, x = row[order], h[order]
            fresh = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])]
            r, x = r[fresh], x[fresh]
            times = np.diff(np.r_[np.flatnonzero(fresh), len(h)])
            distinct = np.bincount(r, minlength=len(counts))
            dense[own, 11] = distinct / n
            most = np.zeros(len(counts))
            np.maximum.at(most, r, times)
            dense[own, 12] = most / n
            pair = h[:-1] == h[1:]
            dense[own, 13] = np.bincount(row[1:][pair & (row[1:] == row[:-1])], minlength=len(counts)) / n
            s, k = textvec.shingles(h, counts, 4)
            sr = textvec.segments(k)
            o = np.lexsort((s, sr))
            sr, s = sr[o], s[o]
            new = np.r_[True, (sr[1:] != sr[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, bool)
            dense[own, 14] = np.bincount(sr[new], minlength=len(counts)) / np.maximum(k, 1)
            sparse.append((first + r, (x % U(HASHED)).astype(np.int64), 1 / np.sqrt(distinct[r])))
        dense[own, 15] = counts == 0
    return dense, sparse


class Classifier:
    """Logistic regression; ``logit`` is the log-likelihood ratio, without the training set's base rate."""

    def __init__(self, texts: list[str], labels: list[int], steps: int = 400):
        y = np.array(labels, float)
        dense, sparse = features(pa.array(texts, pa.string()))
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        x = np.clip((dense - self.mean) / self.scale, -6, 6)
        row, bucket, value = (np.concatenate([s[k] for s in sparse]) if sparse else np.zeros(0, np.int64) for k in range(3))
        w, v, b = np.zeros(DENSE), np.zeros(HASHED), 0.0
        moments = [np.zeros(DENSE), np.zeros(HASHED), 0.0], [np.zeros(DENSE), np.zeros(HASHED), 0.0]
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes count alike
        for step in range(1, steps + 1):
            z = x @ w + np.bincount(row, v[bucket] * value, len(y)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            grads = (x.T @ d + 1e-4 * w, np.bincount(bucket, d[row] * value, HASHED) + 3e-3 * v / np.sqrt(1 + len(y) / 100), d.sum())
            new = []
            for k, (p, g, rate) in enumerate(zip((w, v, b), grads, (0.05, 0.02, 0.05))):
                moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
                moments[1][k] = 0.99 * moments[1][k] + 0.01 * g * g
                new.append(p - rate * (moments[0][k] / (1 - 0.9**step)) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-9))
            w, v, b = new
        self.w, self.v, self.b = w, v, b

    def logit(self, column: pa.Array) -> np.ndarray:
        dense, sparse = features(column)
        z = np.clip((dense - self.mean) / self.scale, -6, 6) @ self.w + self.b
        for row, bucket, value in sparse:
            z += np.bincount(row, self.v[bucket] * value, len(z))
        return np.clip(z, -20, 20)


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", fit_docs: int = FIT_DOCS) -> tuple[Classifier | None, float]:
    """The classifier (None without both classes) and the share of good rows among all labelled rows of training folds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return None, base
    turn = F.xxhash64(F.col("doc_id"), F.lit(12))
    picked = known.where("y = 1").orderBy(turn, "doc_id").limit(fit_docs).unionByName(known.where("y = 0").orderBy(turn, "doc_id").limit(fit_docs))
    rows = (
        docs.select("doc_id", _q(text).alias("text")).where((F.octet_length("text") <= FIT_BYTES) & ~held_out("doc_id"))
        .join(F.broadcast(picked), "doc_id")  # at most 2 * fit_docs rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy(turn, "doc_id").collect()
    )
    if len({r.y for r in rows}) < 2:
        return None, base
    return Classifier([r.text for r in rows], [r.y for r in rows]), base


def evidence(docs: DataFrame, model: Classifier | None, text: str = "text", out: str = "evidence") -> DataFrame:
    """``out`` (double, never null) in place of the text: the log-likelihood ratio. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in (out, text)]
    schema = docs.select(*map(_q, kept)).withColumn(out, F.lit(0.0)).schema
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # 30 kB

    def run(batches):
        own = pickle.loads(shared.value)
        for b in batches:
            for part in portions(b, text, 8_000_000):
                z = own.logit(part.column(text)) if own else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(z, pa.float64())], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def strength(groups: DataFrame, parent: F.Column) -> float:
    """Prior strength s by the method of moments from groups (n, total): between-group variance V of the means about
    their parent against the mean within-group variance p (1 - p); s = p (1 - p) / V - 1, at least 1, at most a million."""
    m = F.col("total") / F.col("n")
    r = groups.where("n > 1").select("n", m.alias("m"), parent.alias("p")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("p")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("within"), F.count("*").alias("k"),
    ).first()
    if not r.k or not r.n:
        return 1e6
    within = r.within / r.n
    between = r.between / r.n - within * r.k / r.n  # less what sampling alone gives
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def posteriors(scored: DataFrame, base: float) -> DataFrame:
    """(host, path, n, host_prior, path_prior): shrunk means of the classifier's probability."""
    p = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(base / (1 - base))))))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(p, 9).cast("decimal(20,9)")).cast("double").alias("total")), "quality")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(30,9)")).cast("double").alias("total"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = min(1 - 1e-6, max(1e-6, (whole.total or 0.0) / max(1, whole.n or 0))) if whole.n else base
    s = strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("total") + s * mean) / (F.col("n") + s)).alias("host_prior"))
    joined = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    t = strength(joined, F.col("host_prior"))
    return joined.select("host", "path", "n", "host_prior", ((F.col("total") + t * F.col("host_prior")) / (F.col("n") + t)).alias("path_prior"))


def assess(docs: DataFrame, labels: DataFrame, host: F.Column, path: F.Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, host, path, evidence, host_prior, path_prior, score) of every document."""
    model, base = fit(docs.select(_q(doc_id).alias("doc_id"), _q(text).alias("text")), labels)
    own = docs.select(_q(doc_id).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), _q(text).alias("text"))
    scored = cut(evidence(own, model), "quality")
    groups = cut(posteriors(scored, base), "quality")
    n, total = groups.count(), scored.count()

    def joined(rows, g):
        g = g.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_prior", "path_prior")
        return rows.join(g, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p")

    if n <= SMALL:
        out = joined(scored, F.broadcast(groups))
    else:
        big = F.col("n") > total // 1_000
        keys = F.broadcast(groups.where(big).select(F.col("host").alias("h"), F.col("path").alias("p")))
        rest = scored.join(keys, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left_anti")
        out = joined(scored, F.broadcast(groups.where(big))).unionByName(joined(rest, groups.where(~big)))
    prior = F.log(F.col("path_prior") / (1 - F.col("path_prior")))
    center = float(np.log(base / (1 - base)))
    logit = F.col("evidence") + center + TRUST * (prior - center)
    return out.withColumn("score", 1 / (1 + F.exp(-logit)))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every document; its source is the host, the language below it the path. ``keep``: a score of 0.5 or more."""
    docs = table(spark, sf_dir, "documents")
    out = assess(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "evidence", "host_prior", "path_prior", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
