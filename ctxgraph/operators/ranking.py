"""Ranking of all files by utility: role, relations, centrality and distance from seeds against size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

RELATION = {
    "config_refs_code": 58, "doc_mentions_code": 42, "entrypoint_to_module": 75, "env_key": 52, "git_cochange": 40, "import": 90,
    "name_similarity": 18, "reexport": 80, "same_dir": 20, "same_package": 28, "semantic_similarity": 15, "test_of": 78,
}
OTHER = 10


def rank_context(files: DataFrame, edges: DataFrame, seeds: DataFrame, mode: str = "focused") -> DataFrame:
    """(path, role, raw_score, score, token_estimate, utility) of all files (path, kind, language, size_bytes, ...).

    raw = (role + relations in + seed bonus + centrality up to 30 + 2 for each edge in - penalty) * decay; the score is raw
    clamped to what the distance allows, cut to an integer; utility = raw / sqrt(tokens + 200), not clamped.
    Order by utility, then score, then path (the last in place of the order of insertion).
    """
    focused = mode == "focused"
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair]), F.col("kind")), F.lit(OTHER))
    incoming = edges.groupBy(F.col("dst").alias("path")).agg(F.sum(weight * F.col("weight") * F.col("confidence")).alias("relations"), F.count("*").alias("n_in"))
    central = graph.degree(edges).withColumnRenamed("node", "path")
    most = central.agg(F.max("degree").alias("most"))  # one row
    own_seeds = seeds.select("path").distinct().withColumn("is_seed", F.lit(True))
    f = (
        files.select("path", "kind", "language", "size_bytes").join(incoming, "path", "left").join(central, "path", "left").join(own_seeds, "path", "left").crossJoin(F.broadcast(most))
        .withColumns({"role": T.role(F.col("path"), F.col("kind"), F.col("language")), "is_seed": F.coalesce("is_seed", F.lit(False))})
    )
    if focused:
        f = f.join(graph.bfs_distance(edges, seeds, files, most=2), "path")  # farther ones count alike
        d = F.col("distance")
        f = f.withColumns({"decay": F.when(d <= 1, 1.0).when(d == 2, 0.5).otherwise(0.1), "bonus": F.when(d == 0, 100).otherwise(0), "cap": F.when(d == 0, 100).when(d == 1, 79).when(d == 2, 74).otherwise(44)})
        lone_test = (F.col("role") == "test") & ~F.col("is_seed")
        f = f.withColumns({"penalty": F.when(lone_test, 80).otherwise(0), "cap": F.when(lone_test, F.least("cap", F.lit(44))).otherwise(F.col("cap"))})
    else:
        f = f.withColumns({"decay": F.lit(1.0), "bonus": F.when(F.col("is_seed"), 100).otherwise(0), "cap": F.lit(100), "penalty": F.lit(0)})
    noise = F.when(F.col("language").isin("json", "lock", "svg"), 50).otherwise(0) + F.col("penalty")
    centrality = F.coalesce(F.when(F.col("most") > 0, F.col("degree") / F.col("most") * 30.0), F.lit(0.0))
    raw = (T.role_score(F.col("role")) + F.coalesce("relations", F.lit(0.0)) + F.col("bonus") + centrality + 2 * F.coalesce("n_in", F.lit(0)) - noise) * F.col("decay")
    f = f.withColumns({"raw_score": raw, "token_estimate": T.tokens_from_bytes(F.col("size_bytes"), F.col("language"))})
    score = F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("raw_score"))).cast("int")
    return f.select("path", "role", "raw_score", score.alias("score"), "token_estimate", (F.col("raw_score") / F.sqrt(F.col("token_estimate") + 200)).alias("utility"))


def order() -> list:
    return [F.desc("utility"), F.desc("score"), F.col("path")]
