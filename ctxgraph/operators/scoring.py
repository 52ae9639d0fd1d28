"""Scores of files, for a snapshot of a project or focused on seeds, with reasons and counts.

Branches of rules are united and reduced by file: the largest score, the number and first example of each kind of reason
in the order of first mention. Reasons are a table of their own, (path, ord, kind, label, seed), so that no file's
reasons are gathered unless a report asks for them; what is kept by file is bounded by the number of kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths
from ..functions import text as T
from . import graph

REASON = "path string, score int, kind string, label string, seed string, seed_ord long, branch int"
ROOT_LABEL = "project config/root file"
PINNED = ("pyproject.toml", "README.md")

#: Kind: (text for one, text for more than one with the count, text without an example).
_TEXTS = {
    "code_file": "code file", "entrypoint": "entrypoint file", "name_similarity": "name similarity", "other_file": "other file", "parent_entrypoint": "parent entrypoint",
    "project_support": "project support file", "related_test": "related test", "same_package": "same package", "seed_file": "seed file", "seed_folder_file": "seed folder file",
    "shared_dependency": "shared dependency bonus", "support_near_seed": "support file", "test_file": "test file",
}


def support_base(category, config: Config) -> F.Column:
    s = config.score
    return (
        F.when(category == "project config", s("project_config")).when(category == "dependency file", s("dependency_file"))
        .when(category.isin("ci support", "runtime config", "runtime support", "tooling config"), s("runtime_support")).otherwise(s("documentation"))
    )


def is_entrypoint(path, config: Config) -> F.Column:
    return paths.matches_any(paths.name(path), config.python.entrypoints)


def _branch(rows: DataFrame, number: int, score, kind, label, seed=None, seed_ord=None) -> DataFrame:
    as_col = lambda x, kind_: x.cast(kind_) if isinstance(x, F.Column) else F.lit(x).cast(kind_)
    return rows.select("path", as_col(score, "int").alias("score"), as_col(kind, "string").alias("kind"), as_col(label, "string").alias("label"), as_col(seed, "string").alias("seed"), as_col(seed_ord if seed_ord is not None else -1, "long").alias("seed_ord"), F.lit(number).alias("branch"))


def snapshot_scores(files: DataFrame, config: Config = Config()) -> DataFrame:
    """``files`` that count, with ``score``, ``reason`` (its kind) and ``label``: by entrypoint, test or else for code, by
    category for support. Row by row, without a join or an aggregation."""
    p, kind, s = F.col("path"), F.col("kind"), config.score
    is_test = T.is_test(p, config.python.test_roots)
    what = F.when(kind == "code", F.when(is_entrypoint(p, config), "entrypoint").when(is_test, "test_file").otherwise("code_file")).when(kind == "support", F.lit("project_support") if config.support else None).when(kind == "other", "other_file")
    points = F.when(F.col("reason") == "entrypoint", s("entrypoint_file")).when(F.col("reason") == "test_file", s("test_file")).when(F.col("reason") == "code_file", s("code_file")).when(F.col("reason") == "other_file", s("other_file")).otherwise(support_base(F.col("support_category"), config))
    label = F.when(F.col("reason") == "project_support", F.coalesce("support_category", F.lit("support file"))).otherwise(F.element_at(F.create_map(*[F.lit(x) for k in ("code_file", "entrypoint", "other_file", "test_file") for x in (k, _TEXTS[k])]), F.col("reason")))
    return files.withColumn("reason", what).where("reason IS NOT NULL").withColumns({"score": points.cast("int"), "label": label})


def snapshot_reasons(files: DataFrame, config: Config = Config()) -> DataFrame:
    """One reason for each file."""
    return _branch(snapshot_scores(files, config), 0, F.col("score"), F.col("reason"), F.col("label"))


def focused_reasons(files: DataFrame, edges: DataFrame, seeds: DataFrame, config: Config = Config()) -> DataFrame:
    """Reasons by the rules around seeds: (seed_ord, seed_rel, is_dir, file), one row for each file of a seed.

    Rules that compare seeds with files by name are joins of the distinct stems on both sides.
    """
    m, s = config.modules_config, config.score
    f = paths.with_path_columns(files)
    sd = seeds.select("seed_ord", "seed_rel", "is_dir", F.col("file").alias("path"))
    first = _branch(
        sd.join(files.select("path"), "path", "left_semi"), 1, F.when(F.col("is_dir"), s("seed_folder_file")).otherwise(s("seed_file")), F.when(F.col("is_dir"), "seed_folder_file").otherwise("seed_file"),
        F.when(F.col("is_dir"), F.concat(F.lit("file inside seed folder `"), F.col("seed_rel"), F.lit("`"))).otherwise("seed file"), F.col("path"), F.col("seed_ord"),
    )
    out = [first]
    seed = sd.groupBy("path").agg(F.min("seed_ord").alias("seed_ord")).select(F.col("path").alias("seed"), "seed_ord")
    seed = seed.withColumns({"seed_parent": paths.parent(F.col("seed")), "seed_stem": T.related_stem(paths.stem(F.col("seed")))})
    named = lambda before, after="`": F.concat(F.lit(before + "`"), F.col("seed"), F.lit(after))
    known = files.select("path")
    if config.modules and m.enabled:
        for flag, reverse, key, number, text in ((m.include_direct_dependencies, False, "direct_dependency", 2, "direct dependency of "), (m.include_reverse_dependencies, True, "reverse_dependency", 3, "imports seed ")):
            if flag:
                walk = graph.weighted_walk(edges, seed.select(F.col("seed").alias("path")), m.depth, m.top_dependencies, reverse)
                rows = walk.withColumnRenamed("node", "path").join(known, "path", "left_semi").join(seed.select("seed", "seed_ord"), "seed")
                out.append(_branch(rows, number, F.greatest(F.lit(m.tree_min_score), (s(key) * F.col("strength")).cast("int")), key, named(text), F.col("seed"), F.col("seed_ord")))
        code = f.where("kind = 'code'").withColumn("file_stem", T.related_stem(F.col("stem")))
        others = code.join(seed.select(F.col("seed").alias("path")), "path", "left_anti")
        if m.include_same_package:
            rows = others.join(seed, others.parent == seed.seed_parent)
            out.append(_branch(rows, 4, s("same_package"), "same_package", named("same package as "), F.col("seed"), F.col("seed_ord")))
        if m.include_parent_entrypoints:
            rows = near(code.where(is_entrypoint(F.col("path"), config)), seed, above=lambda c: F.lit(True))
            out.append(_branch(rows, 5, s("parent_entrypoint"), "parent_entrypoint", named("parent/entrypoint near "), F.col("seed"), F.col("seed_ord")))
        pairs = related(code.select("file_stem").distinct(), seed.select("seed_stem").distinct())
        alike = code.join(pairs, "file_stem").join(seed, "seed_stem")
        if m.include_tests:
            is_test = T.is_test(F.col("path"), config.python.test_roots)
            imports = edges.where(F.col("kind").isin("import", "reexport")).select(F.col("src").alias("path"), F.col("dst").alias("seed")).distinct()
            rows = alike.where(is_test).select("path", "seed", "seed_ord").unionByName(code.where(is_test).join(imports, "path").join(seed, "seed").select("path", "seed", "seed_ord")).distinct()
            out.append(_branch(rows, 6, s("related_test"), "related_test", named("related test for "), F.col("seed"), F.col("seed_ord")))
        rows = alike.join(seed.select(F.col("seed").alias("path")), "path", "left_anti")
        out.append(_branch(rows, 7, s("name_similarity"), "name_similarity", named("name similarity with "), F.col("seed"), F.col("seed_ord")))
        if config.support:
            support = f.where("kind = 'support'").withColumn("base", support_base(F.col("support_category"), config)).withColumn("category", F.coalesce("support_category", F.lit("support file")))
            out.append(_branch(support.where("name = 'pyproject.toml'"), 8, s("project_config"), "project_support", ROOT_LABEL, seed_ord=1 << 40))
            rest = support.where("name <> 'pyproject.toml'")
            rows = near(rest, seed)
            out.append(_branch(rows, 8, F.greatest(F.col("base"), F.lit(s("support_near_seed"))), "support_near_seed", F.concat(F.col("category"), named(" near ")), F.col("seed"), F.col("seed_ord") + F.lit(1 << 41)))
            # a root file is near every seed, so it stands alone only where there is none
            if m.include_project_configs:
                alone = rest.where("parent = '.'").join(rows.select("path").distinct(), "path", "left_anti")
                out.append(_branch(alone, 8, F.col("base"), "project_support", F.col("category"), seed_ord=1 << 40))
    elif config.support:
        out.append(_branch(f.where("path = 'pyproject.toml'"), 8, s("project_config"), "project_support", ROOT_LABEL, seed_ord=1 << 40))
    whole = out[0]
    for b in out[1:]:
        whole = whole.unionByName(b)
    return whole


def near(rows: DataFrame, seed: DataFrame, above=None) -> DataFrame:
    """Files (path, parent) and the seeds that they are near: the file at the root, in the seed's folder, above or below
    it. By equality of folders: the ancestors of either side against the other's folder, not by comparing all pairs."""
    ancestors = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    up = F.when(F.col("seed_parent") == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), ancestors(F.col("seed_parent"))))
    own_up = F.when(F.col("parent") == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), ancestors(F.col("parent"))))
    # the file's folder is the seed's or above it (the root is above all)
    over = rows.join(seed.withColumn("k", F.explode(up)), F.col("parent") == F.col("k")).drop("k")
    # the seed's folder is above the file's
    below = rows.withColumn("k", F.explode(own_up)).where("k <> parent").join(seed, F.col("k") == F.col("seed_parent")).drop("k")
    return over.unionByName(below.select(*over.columns))


def related(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_stem, seed_stem) of stems of which one contains the other: substrings of either that are as long as some of
    the other's stems are looked up among them. Seeds are few, so a file's stem has few lengths to try."""
    a, b = a.where("file_stem <> ''"), b.where("seed_stem <> ''")

    def inside(outer: DataFrame, stem: str, inner: DataFrame, part: str) -> DataFrame:
        lengths = inner.agg(F.coalesce(F.collect_set(F.length(part)), F.array().cast("array<int>")).alias("lengths"))  # one row
        starts = lambda n: F.transform(F.sequence(F.lit(1), F.length(stem) - n + 1), lambda i: F.substring(F.col(stem), i, n))
        parts = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(stem)), starts)))
        return outer.join(F.broadcast(lengths)).select(stem, F.explode(parts).alias(part)).join(inner, part).select("file_stem", "seed_stem")

    return inside(a, "file_stem", b, "seed_stem").unionByName(inside(b, "seed_stem", a, "file_stem")).distinct()


def merge(reasons: DataFrame, config: Config = Config(), bonus: bool = True) -> DataFrame:
    """(path, score, n_seeds, reason_counts, reason_summary): the largest score by file and the reasons by kind; files
    that more than one seed led to get the shared bonus, at most 100 in all."""
    r = reasons.withColumn("turn", F.struct(F.when(F.col("branch") == 1, 0).when(F.col("branch") < 8, 1).otherwise(2).alias("phase"), "seed_ord", "branch", F.coalesce("seed", F.lit("")).alias("s")))
    by_kind = r.groupBy("path", "kind").agg(F.max("score").alias("score"), F.count("*").alias("n"), F.min("turn").alias("turn"), F.min_by("seed", F.when(F.col("seed").isNotNull(), F.col("turn"))).alias("example"), F.min("seed").alias("low"), F.max("seed").alias("high"))
    item = F.struct("turn", "kind", "n", "example")
    by_file = by_kind.groupBy("path").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(item)).alias("kinds"), (F.min("low") < F.max("high")).alias("shared"))  # as many items as kinds
    shared = F.coalesce(F.col("shared"), F.lit(False)) if bonus else F.lit(False)
    extra = F.when(shared, F.array(F.struct(F.lit("shared_dependency").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("example")))).otherwise(F.array().cast("array<struct<kind:string,n:bigint,example:string>>"))
    kinds = F.concat(F.transform("kinds", lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"), x["example"].alias("example"))), extra)
    out = by_file.select("path", F.when(shared, F.least(F.lit(100), F.col("score") + config.score("shared_dependency_bonus"))).otherwise(F.col("score")).cast("int").alias("score"), kinds.alias("kinds"), shared.alias("shared"))
    return out.select("path", "score", "shared", F.map_from_entries(F.transform("kinds", lambda x: F.struct(x["kind"], x["n"]))).alias("reason_counts"), F.array_join(F.transform("kinds", _phrase), "; ").alias("reason_summary"))


def _phrase(x) -> F.Column:
    base = paths.name(x["example"])
    known = F.element_at(F.create_map(*[F.lit(v) for pair in sorted(_TEXTS.items()) for v in pair]), x["kind"])
    many = lambda verb: F.concat(F.lit(verb + " "), x["n"].cast("string"), F.lit(" included files"))
    one = lambda verb: F.concat(F.lit(verb + " "), F.coalesce(base, F.lit("seed")))
    return (
        F.when(x["kind"] == "direct_dependency", F.when(x["n"] > 1, many("imports")).otherwise(one("imports")))
        .when(x["kind"] == "reverse_dependency", F.when(x["n"] > 1, many("imported by")).otherwise(one("imported by")))
        .otherwise(F.coalesce(known, F.replace(x["kind"], F.lit("_"), F.lit(" "))))
    )


def select(scores: DataFrame, files: DataFrame, config: Config = Config(), seeds: DataFrame | None = None) -> DataFrame:
    """Scores that reach the threshold (or belong to seeds), with the file's columns; with ``max_files``, seeds and files
    named as pinned all stay and the rest fill up in order of score, code first, then path."""
    least = min(config.min_score, config.modules_config.tree_min_score)
    rows = scores.join(files, "path")
    own = F.lit(False)
    if seeds is not None:
        rows = rows.join(seeds.select(F.col("file").alias("path")).distinct().withColumn("is_seed", F.lit(True)), "path", "left")
        own = F.coalesce(F.col("is_seed"), F.lit(False))
    rows = rows.withColumn("is_seed", own).where(F.col("is_seed") | (F.col("score") >= least))
    if config.max_files <= 0:
        return rows
    pinned = F.col("is_seed") | paths.name(F.col("path")).isin(*PINNED)
    fixed, rest = rows.where(pinned), rows.where(~pinned)
    left = max(0, config.max_files - fixed.count())
    return fixed.unionByName(rest.orderBy(*order()).limit(left)) if rows.count() > config.max_files else rows


def order() -> list:
    """The total order of candidates."""
    return [F.desc("score"), (F.col("kind") != "code").cast("int"), F.col("path")]


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 1 in the total order."""
    return numbered(rows, order(), "rank")


def numbered(rows: DataFrame, by: list, name: str) -> DataFrame:
    """Places from 1 in an order, without one task numbering all rows: partitions by range are numbered within and moved by
    the counts before them."""
    from ..session import cut

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows, "numbered")  # ranging reads its input twice
    own = cut(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "numbered")
    counts = {r.part: r.n for r in own.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    return own.withColumn(name, (F.row_number().over(Window.partitionBy("part").orderBy(*by)) + offset).cast("long")).drop("part")
