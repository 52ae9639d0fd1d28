"""Tables behind reports: relation groups, import fan-in and fan-out, pack summary, layer previews, why a file is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def among(edges: DataFrame, included: DataFrame) -> DataFrame:
    """Edges with both ends among the included paths."""
    own = included.select("path").distinct()
    return edges.join(own.withColumnRenamed("path", "src"), "src", "left_semi").join(own.withColumnRenamed("path", "dst"), "dst", "left_semi").select(*edges.columns)


def relation_groups(edges: DataFrame, included: DataFrame) -> DataFrame:
    """(src, dst, kind, n, confidence, analyzers)"""
    return among(edges, included).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("analyzer")), ",").alias("analyzers"))


def import_counts(edges: DataFrame, included: DataFrame, most: int = 5) -> DataFrame:
    """(side, path, n): the ``most`` files by distinct included import targets and, the other way, by importers."""
    own = among(edges.where(F.col("kind").isin("import", "reexport")), included).select("src", "dst").distinct()
    side = lambda a, name: own.groupBy(F.col(a).alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most).select(F.lit(name).alias("side"), "path", "n")
    return side("src", "out").unionByName(side("dst", "in"))


def summary(rows: DataFrame) -> DataFrame:
    """(kind, n, n_content, n_tree, tokens) of candidates (kind, included, tokens)."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("included").alias("n_content"), F.count_if(~F.col("included")).alias("n_tree"), F.coalesce(F.sum(F.when(F.col("included"), F.col("tokens"))), F.lit(0)).alias("tokens"))


def layer_preview(layers: DataFrame, most: int = 8) -> DataFrame:
    """(layer, n, preview): the first members of each layer by name, and how many more there are."""
    from pyspark.sql import Window

    first = layers.withColumn("k", F.row_number().over(Window.partitionBy("layer").orderBy("node"))).where(F.col("k") <= most)
    names = first.groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]), ", ").alias("names"))
    n = layers.groupBy("layer").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(", +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(names, "layer").select("layer", "n", F.concat("names", more).alias("preview"))


def why(rows: DataFrame, edges: DataFrame, text: str, order: list) -> tuple[DataFrame, DataFrame]:
    """The first candidate whose path holds the text, whatever the case, and the edges that lead to it."""
    found = rows.where(F.lower("path").contains(text.lower())).orderBy(*order).limit(1)
    return found, edges.join(found.select(F.col("path").alias("dst")), "dst", "left_semi").select(*edges.columns).orderBy("kind", "src")


def warnings(items: DataFrame) -> DataFrame:
    """(n_empty_excerpts, n_unknown_roles) of pack items (content_mode, n_symbols, role)."""
    return items.agg(F.count_if((F.col("content_mode") == "excerpt") & (F.coalesce("n_symbols", F.lit(0)) == 0)).alias("n_empty_excerpts"), F.count_if(F.col("role") == "unknown").alias("n_unknown_roles"))


def folder_language(files: DataFrame) -> DataFrame:
    """(parent, language): the most frequent language of each folder, ties to the smaller name."""
    from ..functions import paths

    n = files.select(paths.parent(F.col("path")).alias("parent"), "language").groupBy("parent", "language").agg(F.count("*").alias("n"))
    return n.groupBy("parent").agg(F.min_by("language", F.struct((-F.col("n")).alias("n"), "language")).alias("language"))
