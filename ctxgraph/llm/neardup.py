"""SimHash near-duplicates by navigable small-world graphs over Hamming distance.

Semantics. A text's signature has 128 + 256 bits: SimHashes over its distinct words (``textvec``). Texts with equal
signatures and numbers of distinct words are one node. Two nodes are linked if their first 128 bits differ in at most
``NEAR`` places, the 256 further, independent bits in at most ``SURE`` (the verification: a pair that chance brought near
in the first bits fails it), and the smaller has at least ``RATIO`` of the other's number of distinct words. Classes are
the components of the links; the class id is the smallest document id. ``n_links`` is the number of other nodes
linked with the document's node.

Texts without words (empty ones, punctuation alone) are linked with nothing; equal ones are one node. A null text is a
class of its own, as is a row with a null id (whose class is null). Rows are kept one for one; repeated ids share a class.
Only the id and the text are looked at; other columns, whatever their names, are left out by ``near_duplicates`` and kept as
they are by ``representatives``.

Search. Sizes fall into ranges, each RATIO of the next, so partners lie in neighbouring ranges. Ranges are split by hash
into shards of about ``SHARD`` nodes; each shard builds its own small-world graph (nodes inserted in batches, each joined
with its nearest found so far) and keeps it in the shared folder. Queries, which are all nodes, are broadcast in blocks of
at most ``BLOCK`` (30 MB) to the shards. A query's beam expands from ``BEAM`` to four times that and then to all of
the shard, as long as half of it lies within range, so that no number of partners is cut off. A sample of nodes
is searched exactly against all nodes. The share found of each node's own partners is averaged over the nodes that have any,
and over those with at most ``FEW`` alone, so a hot group doesn't speak for pairs. If either mean falls short of ``RECALL``,
the search is repeated with twice the beam, until it is exact. A search begins at the node's own place, where the shard
holds it, and at the nodes that share the first bits of a rotated word of the signature (``Prefixes``).

Links are counted but not listed: of a query's partners in a shard, in order of their ids, one that is linked with
an earlier listed one is left out, and the edge from that listed one to it stands in its place, once in a shard. What one
query finds is so joined whole by the query's own edges, even if the searches of its partners miss some of it. A hot group
lists a few edges for each node, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, ship, table
from . import textvec
from .bpe import _q, portions
from .components import components
from .textvec import U

NEAR, SURE, RATIO = 24, 60, 0.7
SHARD, BLOCK, BEAM, JOINED, DEGREE = 1 << 18, 1 << 19, 24, 12, 32
AUDIT, RECALL, FEW = 1_024, 0.97, 8
WORDS64 = 6  # 64-bit words of a signature
FAR = np.int64(1 << 40)
STEP = 2_048
PAIRS = 1 << 22  # covered pairs that wait to be made distinct


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 6) 64-bit words and the number of distinct words of each text."""
    out, sizes = np.zeros((len(column), WORDS64), U), np.zeros(len(column), np.int64)
    for first, counts, h in textvec.words(column):
        if len(h) == 0:
            continue
        row = textvec.segments(counts)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[fresh], h[fresh]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        n = np.diff(np.r_[heads, len(row)])
        own = first + row[heads]
        sizes[own] = n
        for k in range(WORDS64):
            x = textvec.mix(h + U(0x632BE59BD9B4E019 * (k + 1) % 2**64))
            sums = _bit_sums(x, heads)
            out[own, k] = np.packbits(2 * sums > n[:, None], axis=1).view(U)[:, 0]
    return out, sizes


def _bit_sums(x: np.ndarray, heads: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Number of set bits at each of 64 places, by group of rows that begins at ``heads``."""
    sums = np.zeros((len(heads), 64), np.int32)
    at = 0
    while at < len(x):
        stop = min(len(x), at + step)
        low = int(np.searchsorted(heads, at, "right")) - 1
        high = int(np.searchsorted(heads, stop, "left"))
        bits = np.unpackbits(x[at:stop].view(np.uint8).reshape(-1, 8), axis=1)
        sums[low:high] += np.add.reduceat(bits, np.maximum(heads[low:high], at) - at, axis=0, dtype=np.int32)
        at = stop
    return sums


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _linked(sig: np.ndarray, size: np.ndarray, own: np.ndarray, own_size) -> np.ndarray:
    return (
        (_distance(sig[..., :2], own[..., :2]) <= NEAR)
        & (_distance(sig[..., 2:], own[..., 2:]) <= SURE)
        & (np.minimum(size, own_size) >= RATIO * np.maximum(size, own_size))
    )


class Graph:
    """A small-world graph over the first 128 bits. Keys of a beam pack distance, node and an "expanded" bit."""

    def __init__(self, sig: np.ndarray, near: np.ndarray | None = None):
        self.sig = np.ascontiguousarray(sig[:, :2])
        self.near = near if near is not None else np.full((len(sig), DEGREE), -1, np.int32)
        if near is None:
            self._build()

    def _keys(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        return _distance(self.sig[ids], q[:, None, :]) << 33 | ids.astype(np.int64) << 1

    def beam(self, q: np.ndarray, width: int, among: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
        """The nearest nodes found of each query, as keys, by best-first search of all queries in step. ``start``: nodes
        of each query to begin at besides the common entries."""
        n = len(self.sig) if among is None else among
        entries = np.unique(np.linspace(0, n - 1, 16).astype(np.int64))
        keys = self._keys(np.broadcast_to(entries, (len(q), len(entries))), q)
        if start is not None:
            keys = np.sort(np.concatenate((keys, self._keys(start, q)), 1), 1)
            keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = FAR << 1
        if keys.shape[1] < width:
            keys = np.concatenate((keys, np.full((len(q), width - keys.shape[1]), FAR << 1)), 1)
        keys = np.partition(keys, width - 1, axis=1)[:, :width]
        active = np.arange(len(q))
        while len(active):
            k = keys[active]
            ahead = np.where(k & 1, FAR << 2, k)
            at = ahead.argmin(1)
            best = ahead[np.arange(len(active)), at]
            going = best < FAR << 1
            if not going.all():
                active, k, at, best = active[going], k[going], at[going], best[going]
                if len(active) == 0:
                    break
            k[np.arange(len(active)), at] |= 1
            near = self.near[best >> 1 & 0xFFFFFFFF]
            new = self._keys(np.maximum(near, 0), q[active])
            ids = (k >> 1 & 0xFFFFFFFF).astype(np.int32)
            bad = (near < 0) | (new >> 33 >= (k >> 33).max(1)[:, None]) | (near[:, :, None] == ids[:, None, :]).any(2)
            new[bad] = FAR << 1
            keys[active] = np.partition(np.concatenate((k, new), 1), width - 1, axis=1)[:, :width]
        return keys

    def _build(self) -> None:
        n, at = len(self.sig), 0
        while at < n:
            batch = min(n - at, max(256, min(1024, at)))
            ids = np.arange(at, at + batch)
            q = self.sig[ids]
            own = _distance(q[:, None, :], q[None, :, :]) << 33 | ids[None, :] << 1
            own[np.triu_indices(batch)] = FAR << 1  # the earlier ones of the batch
            found = np.partition(own, min(JOINED, batch) - 1, axis=1)[:, :JOINED]
            if at:
                found = np.concatenate((found, self.beam(q, BEAM, at) & ~np.int64(1)), 1)
            found = np.sort(found, 1)[:, :JOINED]
            ok = found < FAR << 1
            to = found >> 1 & 0xFFFFFFFF
            self.near[at : at + batch, : to.shape[1]] = np.where(ok, to, -1)
            # the other way round; a full node keeps its nearest
            source, target, d = np.repeat(ids, to.shape[1])[ok.ravel()], to[ok], found[ok] >> 33
            order = np.lexsort((d, target))
            source, target, d = source[order], target[order], d[order]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            if len(nodes):
                fresh = np.full((len(nodes), count.max()), FAR << 1, np.int64)
                fresh[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = d << 33 | source << 1
                had = self.near[nodes]
                old = np.where(had < 0, FAR << 1, self._keys(np.maximum(had, 0), self.sig[nodes]))
                best = np.sort(np.concatenate((old, fresh), 1), 1)[:, :DEGREE]
                self.near[nodes] = np.where(best < FAR << 1, best >> 1 & 0xFFFFFFFF, -1)
            at += batch

    def near_all(self, q: np.ndarray, width: int, start: Callable[[np.ndarray], np.ndarray] | None = None) -> list[np.ndarray]:
        """Nodes within ``NEAR`` of each query: beams that expand while half of them is in range, then all nodes."""
        out: list = [None] * len(q)
        for k in range(0, len(q), STEP):
            left, now = np.arange(k, min(len(q), k + STEP)), width
            for now in (width, 4 * width):
                if now >= len(self.sig):
                    break
                keys = self.beam(q[left], now, start=None if start is None else start(left))
                inside = keys >> 33 <= NEAR
                full = inside.sum(1) * 2 >= now
                for i, key, ok in zip(left[~full].tolist(), keys[~full], inside[~full]):
                    out[i] = key[ok] >> 1 & 0xFFFFFFFF if ok.any() else None
                left = left[full]
                if len(left) == 0:
                    break
            for i in left.tolist():
                out[i] = np.flatnonzero(_distance(self.sig, q[i]) <= NEAR)
        return out


class Prefixes:
    """The nodes sorted by each rotation of each word of their signatures by a multiple of 16 bits: partners, most of whose
    bits agree, share the first bits of some."""

    def __init__(self, sig: np.ndarray):
        self.sorted = []
        for k in self._rotated(sig):
            order = np.argsort(k).astype(np.int32)
            self.sorted.append((k[order], order))

    @staticmethod
    def _rotated(sig: np.ndarray):
        for w in range(WORDS64):
            for r in (0, 16, 32, 48):
                yield sig[:, w] << U(r) | sig[:, w] >> U(64 - r) if r else sig[:, w]

    def near(self, sig: np.ndarray) -> np.ndarray:
        """Of each query the two nodes before and the two after it in every order."""
        out = []
        for k, (keys, order) in zip(self._rotated(sig), self.sorted):
            at = np.searchsorted(keys, k)[:, None] + np.arange(-2, 2)
            out.append(order[np.clip(at, 0, len(keys) - 1)])
        return np.concatenate(out, 1)


def covering(ids: np.ndarray, sig: np.ndarray, size: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the partners to list: in order of ids, those not linked with one listed before. And of each partner left
    out, in two arrays, the place of the listed one that covers it and its own."""
    out, rest = [], np.argsort(ids)
    heads, gone = [rest[:0]], [rest[:0]]
    while len(rest):
        head, rest = rest[0], rest[1:]
        out.append(int(head))
        if len(rest):
            near = _linked(sig[rest], size[rest], sig[head], size[head])
            gone.append(rest[near])
            heads.append(np.full(len(gone[-1]), head))
            rest = rest[~near]
    return out, np.concatenate(heads), np.concatenate(gone)


def listed(ids: np.ndarray, sig: np.ndarray, size: np.ndarray) -> list[int]:
    return covering(ids, sig, size)[0]


def shard_edges(graph: Graph, nodes: np.ndarray, sig: np.ndarray, size: np.ndarray, queries: tuple[np.ndarray, np.ndarray, np.ndarray], beam: int) -> tuple[list, list, list]:
    """(a, b, links) of the queries (nodes, signatures, sizes) in a shard: their listed partners, the first with the number
    of all; then, without links, the edges from listed partners to those they cover."""
    q_node, q_sig, q_size = queries
    use = np.flatnonzero((q_size >= RATIO * size.min()) & (RATIO * q_size <= size.max()))
    order = np.argsort(nodes)
    place = order[np.minimum(np.searchsorted(nodes, q_node[use], sorter=order), len(nodes) - 1)]
    own, prefixes = nodes[place] == q_node[use], Prefixes(sig)

    def start(which: np.ndarray) -> np.ndarray:
        near = prefixes.near(q_sig[use[which]])
        return np.concatenate((near, np.where(own[which], place[which], near[:, 0])[:, None]), 1)

    a, z, links = [], [], []
    pairs, fresh, waiting = np.zeros(0, np.int64), [], 0
    for j, near in zip(use.tolist(), graph.near_all(np.ascontiguousarray(q_sig[use][:, :2]), beam, start)):
        if near is None:
            continue
        near = near[nodes[near] != q_node[j]]
        near = near[_linked(sig[near], size[near], q_sig[j], q_size[j])]
        if len(near) == 0:
            continue
        picked, heads, gone = covering(nodes[near], sig[near], size[near])
        a += [q_node[j]] * len(picked)
        z += nodes[near[picked]].tolist()
        links += [len(near)] + [0] * (len(picked) - 1)
        fresh.append(near[heads].astype(np.int64) * len(nodes) + near[gone])
        waiting += len(gone)
        if waiting > PAIRS:
            pairs, fresh, waiting = np.unique(np.concatenate((pairs, *fresh))), [], 0
    pairs = np.unique(np.concatenate((pairs, *fresh)))
    a += nodes[pairs // len(nodes)].tolist()
    z += nodes[pairs % len(nodes)].tolist()
    return a, z, links + [0] * len(pairs)


def recall(truth: dict[int, int], found: dict[int, int]) -> float:
    """The lesser mean share found of a node's partners: of all nodes that have any, and of those with few."""
    share = {i: min(found.get(i, 0), n) / n for i, n in truth.items() if n}
    few = [x for i, x in share.items() if truth[i] <= FEW]
    return min((sum(x) / len(x) for x in (list(share.values()), few) if x), default=1.0)


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, sig, n_words): the signature as 48 bytes; of texts without words, a digest of the text; of nulls, null."""

    def run(batches):
        for b in batches:
            for part in portions(b, "text", 16_000_000):
                sig, n = signatures(part.column("text"))
                raw = sig.tobytes()
                sigs = pa.array([raw[48 * i : 48 * i + 48] if k else None for i, k in enumerate(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sigs, pa.array(n.astype(np.int32)), part.column("digest")], names=["doc_id", "sig", "n_words", "digest"])

    own = docs.select(_q(doc_id).cast("long").alias("doc_id"), _q(text).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    made = own.mapInArrow(run, "doc_id long, sig binary, n_words int, digest binary")
    return made.select("doc_id", F.coalesce("sig", "digest").alias("sig"), "n_words")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", beam: int = BEAM) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, class_size (documents)."""
    spark = docs.sparkSession
    ship(spark)
    feats = cut(features(docs, text, doc_id), "neardup")
    nodes = cut(
        feats.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig", "n_words").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")),
        "neardup",
    )
    span = F.floor(F.log(F.col("n_words").cast("double")) / F.lit(-np.log(RATIO))).cast("int")
    alive = nodes.where("n_words > 0").withColumn("span", span)
    counts = {r.span: r.n for r in alive.groupBy("span").agg(F.count("*").alias("n")).collect()}  # some tens of rows
    total = sum(counts.values())
    parts = F.lit(1)
    for s, n in counts.items():
        parts = F.when(F.col("span") == s, F.lit(-(-n // SHARD))).otherwise(parts)
    shards = alive.withColumn("shard", F.pmod(F.xxhash64("node"), parts))

    def build(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        order = np.argsort(textvec.mix(node.astype(U)))  # clusters apart
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), U).reshape(-1, WORDS64)[order]
        near = Graph(sig).near
        row = {"span": t["span"][0].as_py(), "nodes": node[order].tobytes(), "sigs": sig.tobytes(), "sizes": t["n_words"].to_numpy()[order].astype(np.int32).tobytes(), "near": near.tobytes()}
        return pa.table({k: pa.array([v], pa.int32() if k == "span" else pa.large_binary()) for k, v in row.items()}).cast(pa.schema([("span", pa.int32()), *((c, pa.binary()) for c in ("nodes", "sigs", "sizes", "near"))]))

    blocks = -(-total // BLOCK)
    edges = None
    if total:
        graphs = cut(shards.select("node", "sig", "n_words", "span", "shard").groupBy("span", "shard").applyInArrow(build, "span int, nodes binary, sigs binary, sizes binary, near binary"), "neardup")
        sample = alive.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(AUDIT).select("node", "sig", "n_words").collect()
        truth = _exact(alive, sample)
        while True:
            if edges is not None:
                drop_cut(edges)
            edges = cut(_search(alive, graphs, blocks, beam), "neardup")
            found = {r.a: r.n for r in edges.where(F.col("a").isin([r.node for r in sample])).groupBy("a").agg(F.sum("links").alias("n")).collect()}
            if recall(truth, found) >= RECALL or beam >= total:
                break
            beam *= 2
    links = edges.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "node") if edges is not None else nodes.select("node", F.lit(0).cast("long").alias("n_links")).limit(0)
    classes = components(edges.select("a", "b").where("a <> b")) if edges is not None else nodes.select("node", F.col("node").alias("class")).limit(0)
    named = (
        nodes.join(classes, "node", "left").join(links, "node", "left")
        .select("sig", "n_words", "copies", F.coalesce("class", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    sizes = named.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    named = cut(named.join(sizes, "class_id"), "neardup")
    # signatures of over a thousandth of the rows, at most a thousand of them, are joined by broadcast; the rest by key
    n = feats.count()
    hot = named.where(F.col("copies") > max(10_000, n // 1_000))
    keyed = feats.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    on = ["sig", "n_words"]
    out = ["doc_id", "class_id", "n_links", "class_size"]
    rest = keyed.join(F.broadcast(hot.select(*on)), on, "left_anti").join(named, on).select(*out)
    alone = feats.where("sig IS NULL OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return keyed.join(F.broadcast(hot), on).select(*out).unionByName(rest).unionByName(alone)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["node"].to_numpy(), np.frombuffer(b"".join(rows["sig"].to_pylist()), U).reshape(-1, WORDS64), rows["n_words"].to_numpy().astype(np.int64)


def _search(alive: DataFrame, graphs: DataFrame, blocks: int, beam: int) -> DataFrame:
    """(a, b, links): listed edges of all nodes and those among their partners; the number of links of a in a shard stands at one of its rows there."""
    spark, out = alive.sparkSession, None
    for k in range(blocks):
        own = alive.select("node", "sig", "n_words") if blocks == 1 else alive.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(blocks)) == k).select("node", "sig", "n_words")
        shared = spark.sparkContext.broadcast(_arrays(own.toArrow()))

        def run(batches, shared=shared):
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i].as_py() for c in ("nodes", "sigs", "sizes", "near")}
                    nodes, size = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                    sig = np.frombuffer(row["sigs"], U).reshape(-1, WORDS64)
                    graph = Graph(sig, np.frombuffer(row["near"], np.int32).reshape(-1, DEGREE))
                    a, z, links = shard_edges(graph, nodes, sig, size, shared.value, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, z, links)], names=["a", "b", "links"])

        # one shard to a task
        made = graphs.repartitionByRange(max(1, graphs.count()), "span", F.length("nodes")).mapInArrow(run, "a long, b long, links long")
        out = made if out is None else out.unionByName(made)
    return out


def _exact(alive: DataFrame, sample: list) -> dict[int, int]:
    """Number of links of each node of the sample, from a scan of all nodes."""
    nodes, sigs, sizes = [r.node for r in sample], np.frombuffer(b"".join(bytes(r.sig) for r in sample), U).reshape(-1, WORDS64), np.array([r.n_words for r in sample])

    def run(batches):
        for b in batches:
            sig, size, node = np.frombuffer(b"".join(b.column(0).to_pylist()), U).reshape(-1, WORDS64), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            counts = []
            for own, k, i in zip(sigs, sizes, nodes):
                close = np.flatnonzero(_distance(sig[:, :2], own[:2]) <= NEAR)
                counts.append(int((_linked(sig[close], size[close], own, k) & (node[close] != i)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64())], names=["node", "n"])

    made = alive.select("sig", "n_words", "node").mapInArrow(run, "node long, n long")
    return {r.node: r.n for r in made.groupBy("node").agg(F.sum("n").alias("n")).collect()}


def op7_simhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when of each class only the document of the smallest id does. Of rows that share
    that id one stays; rows without an id or a text are in no class and stay.

    Texts and the ids to drop are joined by id, which shuffles the texts once, by the same plan at every size; AQE splits a
    hot id, as the join keeps rows of the texts' side.
    """
    found = cut(near_duplicates(docs, text, doc_id), "neardup")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(doc_id)).distinct()
    left = docs.join(gone.hint("merge"), doc_id, "left_anti").select(*map(_q, docs.columns))
    again = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(doc_id))
    again = cut(again, "neardup")
    if again.isEmpty():
        return left
    twice = left.join(again, doc_id, "left_semi").dropDuplicates([doc_id])
    return left.join(again, doc_id, "left_anti").unionByName(twice).select(*map(_q, docs.columns))
