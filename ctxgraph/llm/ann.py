"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables turns the unit vector, padded with zeros to a power of two, by ``AXES`` fast pseudo-rotations
(three times: random signs, then a Hadamard transform) and assigns it in each to the nearest of the 2d signed axes; together
these name its bucket. A query probes the buckets on whose axes its own coordinates sum up to at least ``reach``, and
what it finds there is reranked by exact cosine in double precision. The reach is set by measurement: for a sample of at
most ``SAMPLE`` queries the true neighbours are found by a scan of all vectors, and the largest reach is taken that finds
``TARGET`` of them. A query that finds fewer than k candidates is searched again over all vectors, so it gets all there are.

Nulls, zero vectors and vectors with a null or non-finite component take no part. Vectors are compared with those of their
own length; buckets serve the length that most vectors have (of ties the smaller), others are scanned. A query's own row is one
row of its id and components; other rows of the same id, equal ones among them, are candidates like any, and repeated query
rows each get their result. Ties go to the smaller id. Other columns are left out, whatever their names. Empty tables
give no rows.

Scale: the vectors stay where they are and are never shuffled. Queries are broadcast in blocks of at most ``BLOCK`` rows.
A task hashes its vectors once for each block, sorts them by bucket and looks the probes up in that order, so a query meets
its candidates alone; the k best of each query are kept through the whole partition, and only these are shuffled. No bucket
is gathered in one task, however many vectors fall into it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, table
from .bpe import _q

TABLES, AXES, SAMPLE, TARGET, BLOCK, SEED = 24, 3, 512, 0.95, 1 << 16, 7
ROWS, QUERIES = 1 << 15, 256  # worked on at a time
RESULT = "q long, query_id long, copies long, vec_id long, score double, own boolean, reach double"
f32 = np.float32


def _square(n: int, known: dict = {1: np.ones((1, 1), f32)}) -> np.ndarray:
    """The Hadamard matrix of n (a power of two) rows."""
    if n not in known:
        h = _square(n // 2)
        known[n] = np.block([[h, h], [h, -h]])
    return known[n]


def hadamard(y: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their width (a power of two), six bits of the index at a time."""
    n, width = y.shape
    left = width
    while left > 1:
        f = min(64, left)
        y = y.reshape(-1, f) @ _square(f)
        if f < width:  # the digit that was the last becomes the first, so that all come round
            y = np.ascontiguousarray(y.reshape(n, width // f, f).transpose(0, 2, 1))
        y = y.reshape(n, width)
        left //= f
    return y


class Rotations:
    def __init__(self, dim: int, tables: int = TABLES, seed: int = SEED):
        self.dim, self.width, self.tables = dim, 1 << max(0, (dim - 1).bit_length()), tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, AXES, 3, self.width)).astype(f32)

    def turn(self, x: np.ndarray, t: int, j: int) -> np.ndarray:
        """Rotated rows of unit vectors."""
        out = np.zeros((len(x), self.width), f32)
        out[:, : self.dim] = x
        for k in range(0, len(x), 1_024):  # stays in the cache
            y = out[k : k + 1_024]
            for s in self.signs[t, j]:
                y = hadamard(y * s)
            out[k : k + 1_024] = y * f32(self.width**-1.5)
        return out

    def axes(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        """The nearest signed axis of each row by each rotation of a table; +i is 2i, -i is 2i + 1."""
        out = []
        for j in range(AXES):
            y = self.turn(x, t, j)
            axis = np.abs(y).argmax(1)
            out.append(2 * axis + (y[np.arange(len(x)), axis] < 0))
        return out

    def signed(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        """Coordinates of each row on the 2 * width signed axes of each rotation of a table."""
        return [np.stack((y, -y), 2).reshape(len(x), -1) for y in (self.turn(x, t, j) for j in range(AXES))]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = _q(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(_q(vec_id).isNotNull() & v.isNotNull()).where(fine).select(_q(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: which rows of the column have it, and their components."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        out[dim] = at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed alike whatever rows come together."""
    x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def candidates(rotations: Rotations, rows: list, q: np.ndarray, n: int, reach: float) -> np.ndarray:
    """(queries, n) of whether a query probes the bucket of a row in any table. ``rows``: by table the order of rows by
    their first two axes, where each pair of axes begins, and their third axis in that order."""
    mark = np.zeros((len(q), n), bool)
    width = 2 * rotations.width
    for t, (order, starts, third) in enumerate(rows):
        a, b, c = rotations.signed(q, t)
        top = [y.max(1) for y in (a, b, c)]
        need = f32(reach - 1e-5) - top[2]  # of the first two axes together
        short = []
        for y, other in ((a, top[1]), (b, top[0])):
            k = int((y >= (need - other)[:, None]).sum(1).max())
            axes = np.argsort(-y, axis=1)[:, :k]
            short.append((axes, np.take_along_axis(y, axes, 1)))
        (ia, ya), (ib, yb) = short
        # of each axis of the first rotation, how many of the second's, largest first, reach far enough with it
        n_b = (yb[:, None, :] >= (need[:, None] - ya)[:, :, None]).sum(2).ravel()
        first = np.repeat(np.arange(len(n_b)), n_b)
        j = np.arange(len(first)) - np.repeat(np.cumsum(n_b) - n_b, n_b)
        who = first // max(1, ia.shape[1])
        pair = ia.ravel()[first] * width + ib[who, j]
        low = starts(pair)
        size = starts(pair + 1) - low
        some = np.flatnonzero(size)
        first, j, who, low, size = (c[some] for c in (first, j, who, low, size))
        left = f32(reach - 1e-5) - ya.ravel()[first] - yb[who, j]
        place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        who, left = np.repeat(who, size), np.repeat(left, size)
        ok = c[who, third[place]] >= left
        mark[who[ok], order[place[ok]]] = True
    return mark


def buckets(rotations: Rotations, x: np.ndarray) -> list:
    """What ``candidates`` needs of rows of unit vectors."""
    out, width = [], 2 * rotations.width
    for t in range(rotations.tables):
        a, b, c = rotations.axes(x, t)
        pair = a * width + b
        order = np.argsort(pair, kind="stable")
        if width * width <= 1 << 20:
            edges = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=width * width))))
            starts = edges.__getitem__
        else:
            starts = pair[order].searchsorted
        out.append((order, starts, c[order]))
    return out


class Search:
    """The k best of each query over the rows of a partition."""

    def __init__(self, block: pa.Table, k: int, dim: int, reach: float | None, measure: bool = False):
        column = block["v"].combine_chunks()
        self.k, self.dim, self.reach, self.measure = k, dim, reach, measure
        self.names = [block[c].to_numpy() for c in ("q", "vec_id", "copies")]
        self.queries = by_length(column if isinstance(column, pa.Array) else column.chunk(0)) if block.num_rows else {}
        self.rotations = Rotations(dim)
        self.best: dict[int, tuple] = {}

    def see(self, ids: np.ndarray, column: pa.Array) -> None:
        for dim, (at, x) in by_length(column).items():
            if dim not in self.queries:
                continue
            which, q = self.queries[dim]
            own = unit(x)
            rows = buckets(self.rotations, own) if dim == self.dim and self.reach is not None else None
            for k in range(0, len(which), QUERIES):
                part = unit(q[k : k + QUERIES])
                mark = None if rows is None else candidates(self.rotations, rows, part, len(x), self.reach)
                for i in range(len(part)):
                    near = slice(None) if mark is None else np.flatnonzero(mark[i])
                    self.add(int(which[k + i]), q[k + i], part[i], ids[at][near], x[near], own[near])

    def add(self, i: int, q: np.ndarray, q_unit: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        if len(ids) == 0:
            return
        k, had = self.k, self.best.get(i)
        close = own @ q_unit
        mine = np.flatnonzero(ids == self.names[1][i])
        mine = mine[(x[mine] == q).all(1)]
        most = k + len(mine)
        least = had[3] if had else -np.inf
        if len(close) > most:  # the products' last bits differ by the order of summation
            least = max(least, np.partition(close, -most)[-most])
        keep = np.flatnonzero(close >= least - 1e-9)
        if len(mine):
            keep = np.union1d(keep, mine)
        if len(keep) == 0:
            return
        is_own = np.isin(keep, mine)
        new = [exact(x[keep], q), ids[keep], is_own]
        if had:
            new = [np.concatenate(c) for c in zip(had[:3], new)]
        order = np.lexsort((new[1], -new[0]))
        own_too = new[2][order]
        # k of the others, and as many of its own rows as could be needed with one left out
        order = order[np.where(own_too, np.cumsum(own_too) <= k + 1, np.cumsum(~own_too) <= k)]
        score, vec, own_too = (c[order] for c in new)
        others = score[~own_too]
        self.best[i] = score, vec, own_too, others[-1] if len(others) >= k else -np.inf, None

    def batch(self, reached=None) -> pa.RecordBatch:
        n = [len(b[0]) for b in self.best.values()]
        who = np.repeat(np.fromiter(self.best, np.int64, len(self.best)), n)
        score, vec, own = (np.concatenate([b[c] for b in self.best.values()]) if n else np.zeros(0, kind) for c, kind in ((0, float), (1, np.int64), (2, bool)))
        far = np.full(len(who), np.nan) if reached is None else reached(who, vec)
        columns = [*(c[who] for c in self.names), vec, score, own, far]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "query_id", "copies", "vec_id", "score", "own", "reach"])


def slices(batches):
    """(ids, vectors) of up to ``ROWS`` rows of the partition."""
    held, n = [], 0
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            if held and n + part.num_rows > ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query; queries have the columns of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    base = usable(vectors, vec_id, vector)
    top = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = top.n
    # equal query rows are searched once and answered each
    asked = usable(queries, vec_id, vector).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asked = cut(asked.select(F.monotonically_increasing_id().alias("q"), "vec_id", "copies", "v"), "ann")

    def scan(block: pa.Table, reach: float | None, measure: bool = False) -> DataFrame:
        """The best candidates of each query and partition."""
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            own = Search(shared.value, k, dim, reach)
            sample = {}
            for t in slices(batches):
                ids, column = t["vec_id"].to_numpy(), t["v"].combine_chunks()
                column = column if isinstance(column, pa.Array) else column.chunk(0)
                own.see(ids, column)
                if measure:  # how far the hashes of the best reach, while their vectors are at hand
                    sample |= reaches(own, ids, column, sample)
            yield own.batch(lambda who, vec: np.array([sample.get((int(i), int(j)), np.nan) for i, j in zip(who, vec)], float) if measure else np.full(len(who), np.nan))

        return base.mapInArrow(run, RESULT)

    sample = asked.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id", F.lit(3)), "q").limit(SAMPLE).toArrow()
    true = _top(scan(sample, None, True), k).where("reach IS NOT NULL AND NOT isnan(reach)").select("reach").collect()
    reach = float(np.sort([r.reach for r in true])[int((1 - target) * len(true))]) if true else None
    total = asked.count()
    best = cut(_top(_blocks(asked, total, lambda b: scan(b, reach)), k), "ann") if total else None
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if reach is not None:
        few = cut(asked.join(best.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= k), "q", "left_anti"), "ann")
        lacking = few.count()
        if lacking:
            again = _top(_blocks(few, lacking, lambda b: scan(b, None)), k)
            best = best.join(few.select("q"), "q", "left_anti").unionByName(again.select(*best.columns))
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")


def reaches(own: Search, ids: np.ndarray, column: pa.Array, known: dict) -> dict:
    """Of each query's best found so far, (query, vec_id) to the largest sum of its coordinates over a bucket's axes."""
    place, x = by_length(column).get(own.dim, (np.zeros(0, np.int64), np.zeros((0, own.dim))))
    at = {int(i): j for j, i in enumerate(ids[place])}
    pairs = [(i, int(v)) for i, b in own.best.items() for v, mine in zip(b[1], b[2]) if not mine and (i, int(v)) not in known and int(v) in at]
    if not pairs or own.dim not in own.queries:
        return {}
    which, q = own.queries[own.dim]
    order = {int(i): j for j, i in enumerate(which)}
    pairs = [p for p in pairs if p[0] in order]
    if not pairs:
        return {}
    a, b = unit(q[[order[i] for i, _ in pairs]]), unit(x[[at[v] for _, v in pairs]])
    far = np.full(len(pairs), -np.inf)
    for t in range(own.rotations.tables):
        far = np.maximum(far, sum(np.take_along_axis(y, axis[:, None], 1)[:, 0] for y, axis in zip(own.rotations.signed(a, t), own.rotations.axes(b, t))))
    return dict(zip(pairs, far.tolist()))


def _blocks(asked: DataFrame, total: int, scan) -> DataFrame:
    """The union of the scans of all queries, block by block."""
    blocks, out = -(-total // BLOCK), None
    for n in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q", F.lit(4)), F.lit(blocks)) == n)
        one = scan(own.toArrow())
        out = one if out is None else out.unionByName(one)
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from the partial results, one of its own rows left out."""
    item = F.struct((-F.col("score")).alias("s"), "vec_id", "score", "own", "reach")
    rows = found.groupBy("q", "query_id", "copies").agg(F.array_sort(F.collect_list(item)).alias("b"))
    own = F.filter("b", lambda x: x["own"])
    others = F.filter("b", lambda x: ~x["own"])
    best = rows.withColumn("b", F.slice(F.array_sort(F.concat(others, F.slice(own, 2, k))), 1, k))
    return best.select("q", "query_id", "copies", F.posexplode("b").alias("p", "b")).select("q", "query_id", "copies", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score", "b.reach")


def op1_cross_polytope_ann(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
