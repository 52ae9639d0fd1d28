"""Connected components of a sparse edge list by alternating star contraction, with the lineage cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of every end of an edge (a, b); the class is the smallest node connected with it.

    Each round hangs every node and its larger neighbours under its smallest neighbour (large star), then its smaller
    neighbours likewise (small star); the number of rounds grows with the logarithm of the longest path. A hot node's
    neighbours are reduced to a minimum before the shuffle and joined back by AQE's skew splitting, never collected.
    Self-loops are ignored; no edges, no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        # every node and its smaller neighbours go under the smallest of them
        small = large.join(small_low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        then = cut(small, "cc")
        # at the fixed point every node hangs under a root, once
        done = then.groupBy().agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        roots = then.select("b").distinct().join(then.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() if done.n == done.k else 1
        drop_cut(now)
        now = then
        if not roots:
            return now.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
