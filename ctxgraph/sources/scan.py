"""A source tree as tables: files with their signatures, and their texts.

Folders that are ignored are pruned while walking. The workers list: a task follows the folders that it is given until it
has seen ``PER_TASK`` entries and hands the rest on to the next round, so a small tree takes one round and a large one is
spread. Contents are read by the workers too, a bounded batch of paths at a time, and only those of files that a query keeps.
Names that begin with a dot or an underscore count like all others; links to folders aren't followed.
"""

from __future__ import annotations

import itertools
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths
from ..operators import classify
from ..session import cut

LISTED = "path string, abs_path string, size_bytes long, mtime_ns long"
PER_TASK = 2_000


class SeedError(ValueError):
    """A seed that can't be used."""


def _pruned(folder: str, config: Config, rules) -> bool:
    import re

    probe = folder + "/x"
    if any(re.search(r.replace(r"\z", r"\Z"), probe) and re.search(r.replace(r"\z", r"\Z"), folder) for r in map(paths.glob_regex, config.hard_ignore) if r):
        return True
    out = False
    for negated, pattern in rules:
        p = pattern.removeprefix("/")
        if p.endswith("/"):
            hit = folder == p.strip("/") or folder.startswith(p.strip("/") + "/")
        elif "/" not in p:
            hit = any(re.search(r"(?s)\A" + paths._translate(p) + r"\Z", part) for part in folder.split("/"))
        else:
            r = paths.glob_regex(p)
            hit = bool(r and re.search(r.replace(r"\z", r"\Z"), folder))
        if hit:
            out = not negated
    return out


def ignore_rules(root: str | Path, config: Config = Config()) -> list[tuple[bool, str]]:
    own = Path(root) / ".gitignore"
    return paths.parse_ignore_file(own.read_text(errors="ignore")) if config.use_gitignore and own.is_file() else []


def listing(spark: SparkSession, root: str | Path, config: Config = Config(), most: int = PER_TASK) -> DataFrame:
    """(path, abs_path, size_bytes, mtime_ns) of the files below a folder, without pruned folders."""
    root, rules = str(Path(root).resolve()), ignore_rules(root, config)
    utf8 = lambda x: os.fsencode(x).decode("utf-8", "replace")

    def below(folder: str):
        """(relative path, size, mtime or -1 for a folder to be listed later)"""
        stack, seen = [folder], 0
        while stack and seen < most:
            rel = stack.pop()
            try:
                entries = list(os.scandir(os.path.join(root, rel)))
            except OSError:
                continue
            for e in entries:
                path = f"{rel}/{e.name}" if rel else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        if not _pruned(path, config, rules):
                            stack.append(path)
                    elif not e.is_dir():
                        s = e.stat()
                        yield path, s.st_size, s.st_mtime_ns
                except OSError:
                    continue
            seen += len(entries)
        for rel in stack:
            yield rel, None, -1

    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = below(folder)
                while part := list(itertools.islice(rows, PER_TASK)):
                    path, size, time = zip(*part)
                    columns = [pa.array(map(utf8, path), pa.string()), pa.array([utf8(os.path.join(root, p)) for p in path], pa.string()), pa.array(size, pa.int64()), pa.array(time, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "abs_path", "size_bytes", "mtime_ns"])

    folders, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = cut(folders.mapInArrow(run, LISTED), "listing")
        files = found.where("size_bytes IS NOT NULL")
        out = files if out is None else out.unionByName(files)
        folders = found.where("size_bytes IS NULL").select("path")
        if folders.isEmpty():
            return out
        folders = folders.repartition(spark.sparkContext.defaultParallelism)


def scan(spark: SparkSession, root: str | Path, config: Config = Config()) -> DataFrame:
    """Classified files of a tree: path, abs_path, kind, language, size_bytes, is_binary, support_category, content_policy,
    mtime_ns."""
    kept = classify.classify(listing(spark, root, config), config, ignore_rules(root, config))
    ext = F.regexp_extract(F.lower(paths.suffix(F.col("path"))), r"\A\.(.*)\z", 1)
    known = ext.isin(*sorted(classify.TEXT | classify.BINARY))
    sure = kept.where(known).withColumn("is_binary", classify.is_binary(F.col("path")))
    heads = contents(kept.where(~known), classify.SNIFF)
    return sure.unionByName(heads.withColumn("is_binary", classify.is_binary(F.col("path"), F.col("content"))).drop("content"))


def contents(files: DataFrame, most: int | None = None) -> DataFrame:
    """Add ``content`` (binary; null where a file can't be read), at most ``most`` bytes of it."""
    schema = files.withColumn("content", F.lit(b"")).schema
    schema["content"].nullable = True
    names = files.columns

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                out = []
                for p in part.column("abs_path"):
                    try:
                        with open(p.as_py(), "rb") as f:
                            out.append(f.read(most) if most else f.read())
                    except OSError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*names, "content"])

    return files.mapInArrow(run, schema)


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text) of the files that aren't binary, with U+FFFD in place of what isn't UTF-8."""
    return contents(files.where("NOT is_binary").select("path", "abs_path")).where("content IS NOT NULL").select("path", classify.lossy_text(F.col("content")).alias("text"))


def resolve_seed(text: str, root: Path, base: Path, external: bool = False) -> Path:
    """The absolute path that a seed means: from the base, else from the root; it must exist and lie inside the root."""
    given = Path(text)
    tries = [given] if given.is_absolute() else [base / given, root / given]
    found = next((p.resolve() for p in tries if p.exists()), None)
    if found is None:
        raise SeedError(f"no such path: {text}")
    if not external and found != root and root not in found.parents:
        raise SeedError(f"outside of the project: {text}")
    return found


def expand_seeds(spark: SparkSession, files: DataFrame, root: Path, seeds: list[Path]) -> tuple[DataFrame, DataFrame]:
    """(files, seeds): seeds as (seed_ord, seed_rel, is_dir, file); a seed file that no pattern names joins the files as kind
    other. A folder means the files below it that aren't binary, and must have one."""
    rows, extra = [], []
    for n, p in enumerate(seeds):
        rel = os.path.relpath(p, root).replace(os.sep, "/")
        rows.append((n, rel, p.is_dir()))
        if p.is_file():
            s = p.stat()
            extra.append((rel, str(p), s.st_size, s.st_mtime_ns))
    if extra:
        new = spark.createDataFrame(extra, LISTED).dropDuplicates(["path"]).join(files.select("path"), "path", "left_anti")
        path = F.col("path")
        files = files.unionByName(new.withColumns({"kind": F.lit("other"), "language": classify.language(path), "support_category": F.lit(None).cast("string"), "content_policy": F.lit("auto"), "is_binary": classify.is_binary(path)}))
    s = spark.createDataFrame(rows, "seed_ord long, seed_rel string, is_dir boolean")  # as many as the user named
    below = F.when(F.col("is_dir"), ((F.col("seed_rel") == ".") | F.startswith("path", F.concat("seed_rel", F.lit("/")))) & ~F.col("is_binary")).otherwise(F.col("path") == F.col("seed_rel"))
    out = files.select("path", "is_binary").join(F.broadcast(s), below).select("seed_ord", "seed_rel", "is_dir", F.col("path").alias("file"))
    empty = s.where("is_dir").join(out.select("seed_ord").distinct(), "seed_ord", "left_anti").first()
    if empty:
        raise SeedError(f"no files in folder: {empty.seed_rel}")
    return files, out
