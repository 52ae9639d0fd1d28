"""Graph analytics over an edge table (src, dst, kind, weight, confidence, ...). Nodes are the ends of edges.

Iterations run until nothing changes; each round's table is written to the shared folder, so plans stay short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop_cut

UNREACHED = 999


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def degree(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(node, degree): the sum of the weights, or the number, of edges in and out; a loop counts twice."""
    value = F.col("weight") if weighted else F.lit(1.0)
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), value.alias("v")).groupBy("node").agg(F.sum("v").alias("degree"))


def kind_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def stats(edges: DataFrame) -> DataFrame:
    """(edges, nodes, avg_degree)"""
    n = edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(nodes(edges).agg(F.count("*").alias("nodes"))).withColumn("avg_degree", F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), F.lit(0.0)))  # one row each


def pagerank(edges: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, iterations: int = 100) -> DataFrame:
    """(node, rank) over distinct links; a node without links out spreads its rank evenly."""
    links = adjacency(edges)
    out = links.groupBy("src").agg(F.count("*").alias("k"))
    links = cut(links.join(out, "src"), "pagerank")
    every = cut(nodes(edges).join(out.select(F.col("src").alias("node"), "k"), "node", "left"), "pagerank")
    n = every.count()
    now = cut(every.select("node", F.lit(1.0 / n if n else 0.0).alias("rank"), F.lit(0.0).alias("change")), "pagerank")
    for _ in range(iterations if n else 0):
        lost = every.where("k IS NULL").join(now, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = damping * lost / n + (1 - damping) / n
        got = links.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * damping / F.col("k")).alias("got"))
        then = now.join(got, "node", "left").select("node", (F.coalesce("got", F.lit(0.0)) + base).alias("new"), "rank").select("node", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("change"))
        then = cut(then, "pagerank")
        change = then.agg(F.sum("change")).first()[0]
        drop_cut(now)
        now = then
        if change < tolerance:
            break
    return now.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of the undirected graph, named by the smallest node. Alternating stars, so the number of
    rounds grows with the logarithm of the longest path."""
    every = nodes(edges)
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        then = cut(small, "components")
        once = then.groupBy().agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        stars = once.n == once.k and then.select(F.col("b").alias("a")).join(then, "a", "left_semi").isEmpty()
        drop_cut(now)
        now = then
        if stars:
            return every.join(now.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def _reach(links: DataFrame, label: DataFrame, forward: bool) -> DataFrame:
    """Spread the smallest label along links until nothing changes; links carry what limits them in ``same``."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    now, news = label, label
    while True:
        got = links.join(news.select(F.col("node").alias(a), "label"), a).groupBy(F.col(b).alias("node")).agg(F.min("label").alias("got"))
        both = cut(now.join(got, "node", "left").select("node", F.least("label", "got").alias("label"), (F.col("got") < F.col("label")).alias("new")), "reach")
        news = both.where("new").select("node", "label")
        now = both.select("node", "label")
        if news.isEmpty():
            return now


def scc(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components, named by the smallest node.

    Nodes without links in or out (of those left) are alone and go first, round by round. Then each node takes the
    smallest label that reaches it; within a label, the nodes that reach the label's own node are its component.
    """
    every = cut(nodes(edges), "scc")
    links = cut(adjacency(edges).where("src <> dst"), "scc")
    done = None
    while not links.isEmpty():
        while True:  # trim
            kept = cut(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            same = kept.count() == links.count()
            links = kept
            if same:
                break
        if links.isEmpty():
            break
        color = _reach(links, nodes(links).select("node", F.col("node").alias("label")), True)
        c = color.select(F.col("node").alias("src"), F.col("label").alias("ls")), color.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
        inside = cut(links.join(c[0], "src").join(c[1], "dst").where("ls = ld").select("src", "dst"), "scc")
        far = F.lit("\U0010ffff")  # beyond every label: not reached
        back = _reach(inside, color.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).otherwise(far).alias("label")), False)
        found = cut(back.where(F.col("label") < far).select("node", F.col("label").alias("scc")), "scc")
        done = found if done is None else done.unionByName(found)
        links = cut(links.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
    if done is None:
        return every.select("node", F.col("node").alias("scc"))
    return every.join(done, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def cycles(edges: DataFrame) -> DataFrame:
    """(scc, size) of the components with more than one node or with a loop."""
    member = scc(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    size = member.groupBy("scc").agg(F.count("*").alias("size"))
    own = member.join(loops, "node", "left_semi").select("scc").distinct().withColumn("looped", F.lit(True))
    return size.join(own, "scc", "left").where("size > 1 OR looped").select("scc", "size")


def topological_layers(edges: DataFrame) -> DataFrame:
    """(node, layer): 0 for nodes with nothing coming in; others one after the last of what comes in. What lies in or
    behind a cycle makes one last layer."""
    left = cut(nodes(edges), "layers")
    links = cut(adjacency(edges), "layers")
    done, layer = None, 0
    while True:
        free = cut(left.join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "layers")
        if free.isEmpty():
            break
        own = free.select("node", F.lit(layer).alias("layer"))
        done = own if done is None else done.unionByName(own)
        left = cut(left.join(free, "node", "left_anti"), "layers")
        links = cut(links.join(free.withColumnRenamed("node", "src"), "src", "left_anti"), "layers")
        layer += 1
    rest = left.select("node", F.lit(layer).alias("layer"))
    return rest if done is None else done.unionByName(rest)


def bfs_distance(edges: DataFrame, seeds: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, distance) of all files: the smaller of the hops along the edges and against them from any seed (path) that
    is a file; 999 where neither reaches, or not within ``most`` hops."""
    start = seeds.select("path").distinct().join(files.select("path"), "path", "left_semi")
    links = cut(adjacency(edges), "bfs")

    def hops(a: str, b: str) -> DataFrame:
        seen = cut(start.select("path", F.lit(0).alias("d")), "bfs")
        front, d = seen.select("path"), 0
        while (most is None or d < most) and not front.isEmpty():
            d += 1
            front = cut(links.join(front.withColumnRenamed("path", a), a).select(F.col(b).alias("path")).distinct().join(seen.select("path"), "path", "left_anti"), "bfs")
            seen = seen.unionByName(front.select("path", F.lit(d).alias("d")))
        return seen

    both = hops("src", "dst").unionByName(hops("dst", "src")).groupBy("path").agg(F.min("d").alias("d"))
    return files.select("path").join(both, "path", "left").select("path", F.coalesce("d", F.lit(UNREACHED)).cast("int").alias("distance"))


def strongest(edges: DataFrame, top: int, reverse: bool = False) -> DataFrame:
    """(u, v, first, later): links from u to v with their strength at the first hop and at later ones; of each u the
    ``top`` of the largest weight times confidence (all, if 0), ties by target and kind."""
    u, v = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"), "kind", (F.col("weight") * F.col("confidence")).alias("s"))
    if top > 0:
        e = e.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v", "kind"))).where(F.col("n") <= top)
    imports = F.col("kind").isin("import", "reexport")
    e = e.select("u", "v", F.when(imports, 1.0).otherwise(F.col("s")).alias("first"), F.when(imports, 0.88).otherwise(F.col("s")).alias("later"))
    return e.groupBy("u", "v").agg(F.max("first").alias("first"), F.max("later").alias("later"))


def weighted_walk(edges: DataFrame, seeds: DataFrame, depth: int = 2, top: int = 10, reverse: bool = False) -> DataFrame:
    """(seed, node, strength): the largest product of strengths over walks of at most ``depth`` hops from each seed (path),
    the seed itself left out. All seeds walk at once; the maximum by level is exact, since no strength is negative."""
    links = strongest(edges, top, reverse)
    now = seeds.select(F.col("path").alias("seed")).distinct().select("seed", F.col("seed").alias("u"), F.lit(1.0).alias("s"))
    out = None
    for hop in range(depth):
        step = F.col("first") if hop == 0 else F.col("later")
        now = now.join(links, "u").where(step > 0).groupBy("seed", F.col("v").alias("u")).agg(F.max(F.col("s") * step).alias("s"))
        out = now if out is None else out.unionByName(now)
    if out is None:
        return now.select("seed", F.col("u").alias("node"), F.col("s").alias("strength")).where("false")
    return out.where("seed <> u AND s > 0").groupBy("seed", F.col("u").alias("node")).agg(F.max("s").alias("strength"))


STRUCTURAL = ("call", "implements", "import", "inherits", "reexport", "type_reference")


def clusters(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, component, n_in, n_out, cluster) over the structural kinds, of all files; the cluster is the first two
    folders, or the language of a file at the root."""
    own = edges.where(F.col("kind").isin(*STRUCTURAL))
    n_in = own.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))
    n_out = own.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_out"))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.least(F.size(F.split("path", "/")) - 1, F.lit(2)), F.lit(0)))
    member = components(own).withColumnRenamed("node", "path")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        files.select("path", "language").join(member, "path", "left").join(n_in, "path", "left").join(n_out, "path", "left")
        .select("path", F.coalesce("component", "path").alias("component"), zero("n_in"), zero("n_out"), F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise(F.col("language")).alias("cluster"))
    )
