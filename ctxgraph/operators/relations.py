"""Relations between files as edge tables (src, dst, kind, weight, confidence, evidence, line, analyzer).

Where only the first of several counts, path order decides. Analyzers are functions (files, texts) -> edges in ``REGISTRY``;
users may add their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as T
from ..session import cut, drop_cut

EDGE = "src string, dst string, kind string, weight double, confidence double, evidence string, line int, analyzer string"
#: weight and confidence by kind
STRENGTH = {
    "config_refs_code": (0.6, 0.8), "doc_mentions_code": (0.42, 0.8), "env_key": (0.4, 0.9), "import": (1.0, 0.98),
    "inherits": (0.7, 0.75), "same_package": (0.5, 1.0), "test_of": (0.85, 0.9), "type_reference": (0.55, 0.7),
}
PACKAGE_MOST = 8
#: Of shared keys: paths compared as one, paths of a block, pairs of a task, tasks at most (beyond, each makes more).
KEY_CHUNK, KEY_BLOCK, KEY_TASK, KEY_TASKS = 256, 4096, 1 << 23, 20_000


def edges(pairs: DataFrame, kind: str, analyzer: str, evidence=None, line=None) -> DataFrame:
    w, c = STRENGTH[kind]
    return pairs.select(
        "src", "dst", F.lit(kind).alias("kind"), F.lit(w).alias("weight"), F.lit(c).alias("confidence"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"), (F.lit(None).cast("int") if line is None else line).alias("line"), F.lit(analyzer).alias("analyzer"),
    )


def dedup(all_edges: DataFrame, order: str | None = None) -> DataFrame:
    """Of edges with equal source, target and kind the one of the largest (weight, confidence); of ties the first by
    ``order``, then analyzer, evidence and line. One aggregation with partial results, no sort of a hot key."""
    rest = [c for c in all_edges.columns if c not in ("src", "dst", "kind", order)]
    tie = [F.col(order)] if order else []
    key = F.struct((-F.col("weight")).alias("k1"), (-F.col("confidence")).alias("k2"), *tie, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias("t" + c) for c in ("analyzer", "evidence", "line")])
    best = all_edges.groupBy("src", "dst", "kind").agg(F.min_by(F.struct(*rest), key).alias("best"))
    return best.select("src", "dst", "kind", *[f"best.{c}" for c in rest])


def test_of(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A test file and the code files whose stem of letters and digits is its own without test markers."""
    f = paths.with_path_columns(files)
    tests = f.where(T.is_test_name(F.col("name"))).select(F.col("path").alias("src"), T.tested_stem(F.col("stem")).alias("k")).where("k <> ''")
    others = f.where(~T.is_test_name(F.col("name"))).select(F.col("path").alias("dst"), T.bare_stem(F.col("stem")).alias("k"))
    named = F.concat(F.lit("test "), paths.name(F.col("src")), F.lit(" names "), paths.name(F.col("dst")))
    return edges(tests.join(others, "k").where("src <> dst"), "test_of", "tests", named)


def same_package(files: DataFrame, texts: DataFrame | None = None, most: int = PACKAGE_MOST) -> DataFrame:
    """A code file and the first ``most`` others of its folder, by path.

    Only the first most + 1 files of a folder can be targets, so a hot folder is reduced to these before the join.
    """
    code = files.where("kind = 'code'").select("path", paths.parent(F.col("path")).alias("parent"))
    first = Window.partitionBy("parent").orderBy("path")
    targets = code.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most + 1).select("parent", F.col("path").alias("dst"), "n")
    pairs = code.withColumnRenamed("path", "src").join(targets, "parent").where("src <> dst")
    # a source among the first ones sees one more; others see the first ``most``
    own = targets.select(F.col("dst").alias("src"), F.col("n").alias("own"))
    pairs = pairs.join(own, "src", "left").where((F.col("n") - F.when(F.col("own") < F.col("n"), 1).otherwise(0)) <= most)
    return edges(pairs, "same_package", "package")


def env_keys(text) -> F.Column:
    """Environment keys that a text reads, once each, sorted."""
    key, quote = "([A-Za-z0-9_]+)", "[\"']"
    forms = [rf"os\.environ(?:\.get[(]|\[){quote}{key}{quote}", rf"os\.getenv\({quote}{key}{quote}\)", rf"process\.env\.{key}", rf"process\.env\[{quote}{key}{quote}\]"]
    found = [F.regexp_extract_all(text, F.lit(form), F.lit(1)) for form in forms]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def shared_keys(keys: DataFrame, chunk: int = KEY_CHUNK, block: int = KEY_BLOCK, task: int = KEY_TASK) -> DataFrame:
    """(src, dst, evidence) of all ordered pairs of different paths that share a key, with the smallest key.

    Each pair is part of the result, so a key of n paths makes n (n - 1) rows. A path brings to each of its keys the numbers of
    its smaller ones, and a pair is made at the one key below which its two paths share none; so no pair is shuffled. Only where
    that moves more, as a path of m keys brings m (m - 1) / 2 numbers (long lists of keys that few paths share), are the pairs by
    key aggregated by pair.
    Paths with the same shared keys are compared as one, ``chunk`` at a time, and spread only in the result. The paths of a
    hot key are laid out in blocks of about ``block``, each pair of blocks a group of its own; a task makes about ``task`` pairs.
    Only the paths of keys beyond a block are sent more than once for a key: n / ``block`` times to either side.
    """
    by_key, same = Window.partitionBy("key"), Window.partitionBy("ks")
    # both cuts hold numbers fast: rows of files are numbered alike when a task is run again, and both sides see the same ones
    found = cut(keys.where("path IS NOT NULL AND key IS NOT NULL").select("path", "key").distinct(), "shared_keys")
    links = found.withColumn("m", F.monotonically_increasing_id())
    # a number of the key's own, and how many paths have it; keys of one path make no pair
    links = links.select("path", "key", F.min("m").over(by_key).alias("id"), F.count("*").over(by_key).alias("n")).where("n > 1")
    own = links.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "id", "n"))).alias("ks"))
    own = own.withColumn("c", F.floor((F.row_number().over(same.orderBy("path")) - 1) / chunk))
    classes = cut(own.groupBy("ks", "c").agg(F.collect_list("path").alias("paths")).select("ks", "paths"), "shared_keys")
    drop_cut(found)
    # ordered pairs by key, and numbers that paths bring to their keys
    total = classes.agg(F.sum(F.size("paths").cast("double") * F.aggregate("ks", F.lit(0.0), lambda s, k: s + k.n)).alias("pairs"), F.sum(F.pow(F.size("ks"), F.lit(2))).alias("numbers")).first()
    pairs = total.pairs or 0
    if pairs <= (total.numbers or 0):
        k = classes.select(F.explode("paths").alias("path"), "ks.key").select("path", F.explode("key").alias("key"))
        a, b = k.select(F.col("path").alias("src"), "key"), k.select(F.col("path").alias("dst"), "key")
        return a.join(b, "key").where("src <> dst").groupBy("src", "dst").agg(F.min("key").alias("evidence"))
    blocks = F.ceil(F.col("k.n") / block)
    at = classes.select("paths", F.col("ks.id").alias("ids"), F.posexplode("ks").alias("p", "k")).select("k.key", "k.id", "paths", F.slice("ids", F.lit(1), F.col("p")).alias("smaller"), blocks.alias("blocks"), F.pmod(F.xxhash64(F.col("paths")[0]), blocks).alias("own"))
    each, tasks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), min(max(int(pairs / task) + 1, 1), KEY_TASKS)
    a = at.select("id", F.col("own").alias("i"), each.alias("j"), "key", F.col("paths").alias("srcs"), F.col("smaller").alias("sa")).repartition(tasks, "id", "i", "j")
    b = at.select("id", each.alias("i"), F.col("own").alias("j"), F.col("paths").alias("dsts"), F.col("smaller").alias("sb")).repartition(tasks, "id", "i", "j")
    met = a.join(b.hint("merge"), ["id", "i", "j"]).where(~F.arrays_overlap("sa", "sb"))
    return met.select(F.explode("srcs").alias("src"), "dsts", "key").select("src", F.explode("dsts").alias("dst"), F.col("key").alias("evidence")).where("src <> dst")


def env_key(files: DataFrame, texts: DataFrame) -> DataFrame:
    keys = texts.join(files.where("kind = 'code'").select("path"), "path", "left_semi").select("path", F.explode(env_keys(F.col("text"))).alias("key"))
    return edges(shared_keys(keys), "env_key", "env", F.col("evidence"))


def is_config_name(path) -> F.Column:
    name = F.lower(paths.name(path))
    return name.isin("dockerfile", "package.json", "pyproject.toml", "setup.py") | F.lower(paths.suffix(path)).isin(*[f".{x}" for x in "json toml yaml yml".split()])


def is_doc_name(path) -> F.Column:
    """``doc`` anywhere in the name counts, so Dockerfile does too."""
    name = F.lower(paths.name(path))
    return name.isin("readme", "readme.md", "readme.txt") | name.contains("doc")


#: A run in which a name can stand as a whole word starts after none of these characters.
RUN = r"(?U)[\w./-]+"


def mentions(texts: DataFrame, code: DataFrame) -> DataFrame:
    """(src, dst): texts (path, text) and the code files (path) that they mention by path or name.

    An equi-join, not a comparison of every text with every name: a whole-word mention of a name begins a run of word
    characters, dots, slashes and hyphens, so the prefixes of a text's distinct runs that end before a non-word character
    are looked up among the names. A path ends in its name, after a slash, so prefixes of the parts of a run are looked up
    likewise, and the folders before must end the run's text up to there. Only prefixes as long as some name are made and
    only as many folders kept as a path has, so a run costs as much as it is long. Names with other characters than
    those of runs, and the path of a file at the root, which is its name, are tested as names.
    """
    names = code.select(F.col("path").alias("dst"), paths.name(F.col("path")).alias("name"), F.col("path").contains("/").alias("nested"))
    plain = names.where(F.col("name").rlike(r"\A" + RUN + r"\z"))
    odd = names.where(~F.col("name").rlike(r"\A" + RUN + r"\z"))
    # one row: the lengths of names (of files, so a few hundred at most) and the depth of the deepest path
    sizes = plain.agg(F.coalesce(F.array_sort(F.collect_set(F.length("name"))), F.array().cast("array<int>")).alias("lengths"), F.coalesce(F.max(F.size(F.split("dst", "/"))), F.lit(1)).alias("depth"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({RUN})"), F.lit(1)))
    runs = texts.select("path", F.explode(found).alias("run")).join(F.broadcast(sizes)).where(F.length("run") >= F.get("lengths", F.lit(0)))
    prefix = lambda c, n: F.substring(c, F.lit(1), n)
    # before a character that isn't a word character, or the end
    whole = F.filter("lengths", lambda n: (n == F.length("run")) | (n < F.length("run")) & ~F.substring("run", n + 1, F.lit(1)).rlike(r"(?U)\w"))
    heads = runs.select("path", F.explode(F.transform(whole, lambda n: prefix(F.col("run"), n))).alias("name"))
    by_name = heads.join(plain, "name").select("path", "dst")
    parts = runs.where(F.col("run").contains("/")).withColumn("parts", F.split("run", "/"))
    above = lambda i: F.array_join(F.slice("parts", F.greatest(F.lit(1), i - F.col("depth") + 1), F.least(F.col("depth") - 1, i - 1)), "/")
    each = parts.select("path", "lengths", F.explode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda i: F.struct(F.element_at("parts", i).alias("part"), above(i).alias("folder")))).alias("p"))
    each = each.where(F.length("p.part") >= F.get("lengths", F.lit(0))).select("path", "p.folder", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("p.part")), lambda n: prefix(F.col("p.part"), n))).alias("name"))
    by_path = each.join(plain.where("nested"), "name").where(F.endswith(F.concat_ws("/", "folder", "name"), F.col("dst"))).select("path", "dst")
    rest = texts.join(odd, F.col("text").contains(F.col("name"))).where(T.mentions(F.col("text"), F.col("dst")) | T.mentions(F.col("text"), F.col("name"))).select("path", "dst")
    # a path at an odd place: with characters outside runs in a folder
    strange = plain.where("nested").where(~F.col("dst").rlike(r"\A" + RUN + r"\z"))
    more = texts.join(strange, F.col("text").contains(F.col("dst"))).select("path", "dst")
    return by_name.unionByName(by_path).unionByName(rest).unionByName(more).distinct().withColumnRenamed("path", "src")


def config_refs(files: DataFrame, texts: DataFrame) -> DataFrame:
    own = texts.where(is_config_name(F.col("path"))).join(files.select("path"), "path", "left_semi")
    return edges(mentions(own, files.where("kind = 'code'")), "config_refs_code", "config_refs")


def doc_mentions(files: DataFrame, texts: DataFrame) -> DataFrame:
    own = texts.where(is_doc_name(F.col("path"))).join(files.select("path"), "path", "left_semi")
    return edges(mentions(own, files.where("kind = 'code'")), "doc_mentions_code", "docs")


REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"tests": test_of, "package": same_package, "env": env_key, "config_refs": config_refs, "docs": doc_mentions}


def build(files: DataFrame, texts: DataFrame, imports: DataFrame | None = None, registry=None) -> DataFrame:
    """All relations of the registry and the given edges, deduplicated."""
    out = None if imports is None else imports
    for f in (REGISTRY if registry is None else registry).values():
        e = f(files, texts)
        out = e if out is None else out.unionByName(e)
    return dedup(out)
