"""Benchmark decontamination by size-partitioned MinHash containment.

Semantics: a text is its words (``textvec``: case and punctuation don't count); an item is the set S of hashes of its runs
of ``K`` words. Items fall into partitions by length: partition u (a power of 2) holds those with u/2 < n <= u runs,
repeated ones counted. A document is cut, for each partition, into windows of 2u runs that start every u runs, so that an
item's passage lies whole in one of them. A window contains the item if it holds at least ``THRESHOLD`` of S.

Search: each item's sketch is the ``SKETCH`` smallest mixed hashes of S (all of S for most items). The share of the sketch
that a window holds estimates the containment; windows within ``SLACK`` of the threshold (four standard deviations of
the estimate) are candidates, and of these the exact share of S is computed. Short items can't hide in long documents,
as windows follow the size of the item, not of the document.

A share of an item of fewer than ``MIN_WORDS`` words is no evidence: it is contained, with containment 1, only where all its
words stand in a row. Items without words, null ones among them, are contained in nothing; null and empty documents contain
nothing. Of repeated items each is reported; repeated documents are each reported. Texts of any length are searched whole.
Other columns pass through, but for one named as the result, which is replaced.

Scale: documents are read once and never shuffled. The benchmark is broadcast in blocks of at most ``BLOCK`` hashes
(32 MB), however many there are; only an item longer than that makes a larger block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from . import textvec
from .bpe import _q, portions
from .textvec import U

K, THRESHOLD, SKETCH, SLACK, MIN_WORDS, BLOCK = 4, 0.6, 64, 0.25, 8, 1 << 22
LEAKS = "array<struct<item_id:bigint,containment:double>>"


class Index:
    """Sketches and shingle sets of a block of items (id, words, distinct hashes, runs), as flat arrays."""

    def __init__(self, items: list[tuple[int, int, np.ndarray, int]]):
        short = [x for x in items if x[1] < MIN_WORDS]
        #: Of short items by number of words: hashes of all their words, sorted, and the ids.
        self.short = {w: self._sorted([x[2] for x in short if x[1] == w]) + ([x[0] for x in short if x[1] == w],) for w in {x[1] for x in short}}
        items = [x for x in items if x[1] >= MIN_WORDS]
        self.ids = np.array([x[0] for x in items], np.int64)
        sets = [np.unique(x[2]) for x in items]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        runs = np.array([x[3] for x in items], np.int64)
        self.width = 1 << np.ceil(np.log2(np.maximum(runs, 1))).astype(np.int64)
        # bottom-k by another mixing than the one that sorts the sets
        chosen = [s[np.argsort(textvec.mix(s), kind="stable")[:SKETCH]] for s in sets]
        self.sketch_sizes = np.array([len(s) for s in chosen], np.int64)
        self.sketch, self.sketch_item = self._sorted(chosen)
        self.full, self.full_item = self._sorted(sets)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.full & U(0xFFFFF)).astype(np.int64)] = True

    @staticmethod
    def _sorted(sets):
        values = np.concatenate(sets) if sets else np.zeros(0, U)
        item = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((item, values))
        return values[order], item[order]

    @staticmethod
    def _pairs(values, item, h, at):
        """(place in h, item) wherever a hash of ``h[at]`` is a value."""
        low, high = np.searchsorted(values, h[at], "left"), np.searchsorted(values, h[at], "right")
        n = high - low
        k = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), item[k], values[k]

    def _shares(self, places, item, value, base, sizes):
        """(window, item, share) of each window and item: the distinct values there, divided by ``sizes``."""
        if len(places) == 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        own = places - base[places]
        w = own // self.width[item]
        w, item, value, start = (np.concatenate((a, a)) for a in (w, item, value, base[places]))
        w[len(places) :] -= 1
        ok = w >= 0
        w, item, value, start = w[ok], item[ok], value[ok], start[ok]
        order = np.lexsort((value, w, item, start))
        w, item, value, start = w[order], item[order], value[order], start[order]
        same = np.zeros(len(w), bool)
        same[1:] = (start[1:] == start[:-1]) & (item[1:] == item[:-1]) & (w[1:] == w[:-1])
        fresh = ~same
        fresh[1:] |= value[1:] != value[:-1]
        heads = np.flatnonzero(~same)
        count = np.add.reduceat(fresh.astype(np.int64), heads)
        return start[heads], item[heads], count / sizes[item[heads]]

    def search(self, h: np.ndarray, counts: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(row, item id, containment) of rows of so many shingles each; of every pair the best window."""
        near = np.flatnonzero(self.bits[(h & U(0xFFFFF)).astype(np.int64)])
        if len(near) == 0:
            return []
        base = np.repeat(np.cumsum(counts) - counts, counts)
        row_of = textvec.segments(counts)
        start, item, share = self._shares(*self._pairs(self.sketch, self.sketch_item, h, near), base, self.sketch_sizes)
        ok = share >= threshold - np.where(self.sizes[item] > SKETCH, SLACK, 0) - 1e-9
        if not ok.any():
            return []
        wanted = np.unique(start[ok] * len(self.ids) + item[ok])
        places, item, value = self._pairs(self.full, self.full_item, h, near)
        keep = np.isin(base[places] * len(self.ids) + item, wanted)
        start, item, share = self._shares(places[keep], item[keep], value[keep], base, self.sizes)
        ok = share >= threshold - 1e-9
        start, item, share = start[ok], item[ok], share[ok]
        order = np.lexsort((-share, item, start))
        start, item, share = start[order], item[order], share[order]
        best = np.ones(len(start), bool)
        best[1:] = (start[1:] != start[:-1]) | (item[1:] != item[:-1])
        return [(int(row_of[s]), int(self.ids[i]), float(x)) for s, i, x in zip(start[best], item[best], share[best])]


    def search_short(self, h: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float]]:
        """The same of short items, in rows of so many words each."""
        out = set()
        for w, (values, item, ids) in self.short.items():
            s, n = textvec.shingles(h, counts, w)
            s, n = s[np.repeat(counts >= w, n)], np.where(counts >= w, n, 0)  # a shorter row has one run of all it has
            near = np.flatnonzero(np.isin(s, values))
            places, found, _ = self._pairs(values, item, s, near)
            out |= set(zip(textvec.segments(n)[places].tolist(), [ids[i] for i in found.tolist()], [1.0] * len(places)))
        return sorted(out)


def shingled(column: pa.Array):
    """(first row, number of shingles by row, their hashes, number of words by row, their hashes) of runs of rows."""
    for first, counts, h in textvec.words(column):
        s, n = textvec.shingles(h, counts, K)
        yield first, n, s, counts, h


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK):
    """Lists of (id, words, hashes, runs) of at most ``most`` hashes together, streamed to the driver one after the other."""

    def run(batches):
        for b in batches:
            for first, n, s, words, h in shingled(b.column(1)):
                rows = []
                ids = b.column(0)[first : first + len(n)].to_pylist()
                for i, x, w, own in zip(ids, np.split(s, np.cumsum(n)[:-1]), words.tolist(), np.split(h, np.cumsum(words)[:-1])):
                    if i is not None and w:
                        hashes = np.unique(x) if w >= MIN_WORDS else textvec.shingles(own, np.array([w]), w)[0]
                        rows.append((i, w, hashes.tobytes(), len(x)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "hashes", "runs"])

    out, size = [], 0
    for r in benchmark.select(_q(item).cast("long"), _q(text)).mapInArrow(run, "item_id long, words int, hashes binary, runs long").toLocalIterator():
        h = np.frombuffer(r.hashes, U)
        if out and size + len(h) > most:
            yield out
            out, size = [], 0
        out.append((r.item_id, r.words, h, r.runs))
        size += len(h)
    if out:
        yield out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``out``: the items that each document contains, with the containment, by item id. Never null."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c != out]
    result = docs.select(*map(_q, kept)).withColumn(out, F.expr(f"CAST(array() AS {LEAKS})"))
    schema = result.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))
    for block in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for b in batches:
                for part in portions(b, text, 16_000_000):
                    found = [list(x.as_py() or []) for x in part.column(out)]
                    for first, n, s, words, h in shingled(part.column(text)):
                        for r, i, share in index.search(s, n, threshold) + index.search_short(h, words):
                            found[first + r].append({"item_id": i, "containment": share})
                    found = pa.array([sorted(x, key=lambda y: y["item_id"]) for x in found], kind)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [found], names=[*kept, out])

        result = result.mapInArrow(run, schema)
    return result


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.containment", 9).alias("containment"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[\x{{80}}-\x{{a9}}\x{{ab}}-\x{{b4}}\x{{b6}}-\x{{b9}}\x{{bb}}-\x{{bf}}\x{{2000}}-\x{{206f}}\x{{3000}}-\x{{303f}}\x{{feff}}]', ' ', 'g')), '[0-9a-z_\x{{80}}-\x{{10ffff}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[\x{{80}}-\x{{a9}}\x{{ab}}-\x{{b4}}\x{{b6}}-\x{{b9}}\x{{bb}}-\x{{bf}}\x{{2000}}-\x{{206f}}\x{{3000}}-\x{{303f}}\x{{feff}}]', ' ', 'g')), '[0-9a-z_\x{{80}}-\x{{10ffff}}]+') AS w FROM benchmark),
br AS (SELECT item_id, array_to_string(w[i : i + {K - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM b WHERE len(w) >= {MIN_WORDS})),
bs AS (SELECT DISTINCT item_id, s FROM br),
bn AS (SELECT item_id, count(DISTINCT s) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS u FROM br GROUP BY item_id),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i : i + {K - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d)),
hits AS (SELECT doc_id, item_id, n, p // u AS k, s FROM ds JOIN bs USING (s) JOIN bn USING (item_id)),
twice AS (SELECT doc_id, item_id, n, k, s FROM hits UNION ALL SELECT doc_id, item_id, n, k - 1, s FROM hits WHERE k > 0),
shares AS (SELECT doc_id, item_id, count(DISTINCT s) / any_value(n) AS c FROM twice GROUP BY doc_id, item_id, k)
SELECT doc_id, item_id, round(max(c), 9) AS containment FROM shares GROUP BY doc_id, item_id HAVING max(c) >= {THRESHOLD} - 1e-9
UNION ALL
SELECT DISTINCT doc_id, item_id, 1.0::DOUBLE AS containment FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d) x JOIN (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM b WHERE len(w) BETWEEN 1 AND {MIN_WORDS - 1}) y ON contains(x.t, y.t)
"""
