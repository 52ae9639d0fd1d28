"""Incremental rebuilds: signatures of files, what changed, which edges survive, caches keyed by signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNATURE = ("mtime_ns", "size_bytes")


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted against the signatures (path, mtime_ns, size_bytes) of a snapshot."""
    a = files.select("path", *[F.col(c).alias("a_" + c) for c in SIGNATURE], F.lit(True).alias("here"))
    b = before.select("path", *[F.col(c).alias("b_" + c) for c in SIGNATURE], F.lit(True).alias("there"))
    same = F.lit(True)
    for c in SIGNATURE:
        same = same & F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    what = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~same, "modified")
    return a.join(b, "path", "full_outer").select("path", what.alias("change")).where("change IS NOT NULL")


def survivors(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with neither end changed."""
    gone = changes.select("path").distinct()
    return edges.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti").select(*edges.columns)


def to_rebuild(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with an end that changed."""
    gone = changes.select("path").distinct()
    hit = edges.join(gone.withColumnRenamed("path", "src"), "src", "left_semi").select(*edges.columns)
    rest = edges.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_semi").select(*edges.columns)
    return hit.unionByName(rest)


def cache_hits(files: DataFrame, cache: DataFrame, config_hash: str) -> DataFrame:
    """Cache rows (path, mtime_ns, size_bytes, config_hash, ...) that are valid for the files at hand."""
    return cache.where(F.col("config_hash") == config_hash).join(files.select("path", *SIGNATURE).distinct(), ["path", *SIGNATURE], "left_semi")


def prune_cache(cache: DataFrame, files: DataFrame, max_entries: int) -> DataFrame:
    """Cache rows of files that exist, at most ``max_entries``: the latest by time, then by path."""
    kept = cache.join(files.select("path").distinct(), "path", "left_semi")
    return kept.orderBy(F.desc("mtime_ns"), "path").limit(max_entries) if max_entries > 0 else kept


def write(path: str, files: DataFrame, edges: DataFrame, config_hash: str) -> None:
    """Edges first, so that a run that is broken off leaves no signatures that they don't belong to."""
    edges.withColumn("config_hash", F.lit(config_hash)).write.mode("overwrite").parquet(f"{path}/edges")
    files.select("path", *SIGNATURE).withColumn("config_hash", F.lit(config_hash)).write.mode("overwrite").parquet(f"{path}/files")


def read(spark, path: str, config_hash: str) -> tuple[DataFrame, DataFrame] | None:
    """(signatures, edges) of a snapshot with the same settings, None where there is none."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        files, edges = spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/edges")
        if files.isEmpty():
            return None
        if files.where(F.col("config_hash") != config_hash).isEmpty() and edges.where(F.col("config_hash") != config_hash).isEmpty():
            return files.drop("config_hash"), edges.drop("config_hash")
    except (AnalysisException, Py4JJavaError):
        pass
    return None


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
