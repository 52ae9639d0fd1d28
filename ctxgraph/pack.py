"""A pack: what of a source tree is worth reading, around seeds or as a whole, within a budget."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions import text as T
from .operators import budget, extract, ranking, relations, report, scoring, snapshot
from .render import exports, reports
from .session import cut
from .sources import scan


@dataclass
class Pack:
    root: Path
    config: settings.Config
    mode: str
    seeds: list[str]
    files: DataFrame
    edges: DataFrame
    candidates: DataFrame
    only_tree: bool = False
    rows: list = field(default_factory=list)
    items: list = field(default_factory=list)
    texts: dict = field(default_factory=dict)
    imports: list = field(default_factory=list)
    relations: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    target: int = 0
    total_tokens: int = 0
    timings: dict = field(default_factory=dict)

    def render(self) -> str:
        return reports.llm(self) if self.items else reports.plain(self) if self.config.format == "txt" else reports.markdown(self)


def _tree_text(root: Path, name: str) -> str | None:
    p = root / name
    return p.read_text(errors="ignore") if p.is_file() else None


def load_config(paths, config_path=None, profile=None, **overrides) -> tuple[settings.Config, Path]:
    """(settings, root): the TOML file given or nearest to the paths; its folder is the root, else the first path's."""
    first = Path(paths[0]) if paths else Path.cwd()
    found = Path(config_path) if config_path else settings.find_file(first)
    c = settings.from_toml(found.read_text()) if found else settings.Config()
    root = found.resolve().parent if found else (first if first.is_dir() else first.parent).resolve()
    return settings.with_overrides(settings.with_profile(c, profile), **overrides), root


def relate(spark: SparkSession, root: Path, files: DataFrame, texts: DataFrame, c: settings.Config) -> tuple[DataFrame, bool]:
    """(edges, whether they were restored): those of the snapshot in the cache folder if no file was added, modified or
    deleted since and all that resolution depends on is the same; else they are built from the texts and kept there."""
    outside = [_tree_text(root, name) for name in ("tsconfig.json", "package.json", "go.mod")]
    key = hashlib.sha256(json.dumps([settings.scan_hash(c), *outside]).encode()).hexdigest()
    store = f"file://{root / c.cache.dir / 'graph'}"
    before = snapshot.read(spark, store, key)
    if before is not None and snapshot.changed(files, before[0]).isEmpty():
        return before[1], True
    imports = extract.import_edges(files, texts, c, extract.js_aliases(*outside[:2]), extract.go_module(outside[2]))
    edges = cut(relations.build(files, texts, imports), "edges")
    snapshot.write(store, files, edges, key)
    return edges, False


def build_pack(
    spark: SparkSession, paths, config_path=None, profile=None, output=None, output_format=None, only_tree=None, modules=None, support=None,
    max_files=None, max_tokens=None, min_score=None, support_content=None, progress_callback=None, project=False, path_base="project",
) -> Pack:
    """Scan, relate, score and select. Of the result, only what was selected comes to the driver."""
    say = progress_callback or (lambda *_: None)
    timings, began = {}, time.time()

    def done(name):
        nonlocal began
        timings[name], began = time.time() - began, time.time()
        say(name)

    paths = [str(p) for p in (paths or ["."])]
    c, root = load_config(
        paths, config_path, profile, support=support, support_content=support_content, modules=modules,
        format=output_format, output=output, only_tree=only_tree, min_score=min_score, max_tokens=max_tokens, max_files=max_files,
    )
    done("config_load")
    base = Path.cwd() if path_base == "cwd" else root
    given = [scan.resolve_seed(p, root, base, c.allow_external_paths) for p in paths]
    whole = profile == "full" or project or root in given
    mode = "focused" if profile == "focused-gpt" or not whole else "project_snapshot"
    files, seeds = scan.expand_seeds(spark, scan.scan(spark, root, c), root, given)
    files, seeds = cut(files, "files"), cut(seeds, "seeds")
    done("scan")
    texts = scan.read_texts(files)
    edges, restored = relate(spark, root, files, texts, c)
    done("graph_restore" if restored else "graph_build")
    names = [r.seed_rel for r in seeds.select("seed_ord", "seed_rel").distinct().orderBy("seed_ord").collect()]
    pack = Pack(root, c, mode, names, files, edges, files, bool(c.only_tree), timings=timings)
    explicit = seeds if mode == "focused" else seeds.where("NOT is_dir")
    if profile in settings.LLM_PROFILES:
        _llm(pack, explicit, texts, done)
        return pack
    reasons = scoring.focused_reasons(files, edges, seeds, c) if mode == "focused" else scoring.snapshot_reasons(files, c)
    rows = scoring.select(scoring.merge(reasons, c, bonus=mode == "focused"), files, c, seeds if mode == "focused" else None)
    own = explicit.select(F.col("file").alias("path")).distinct().withColumn("seed", F.lit(True))
    ranked = scoring.ranked(rows.drop("is_seed").join(own, "path", "left").withColumn("is_seed", F.coalesce("seed", F.lit(False))).drop("seed"))
    done("scoring")
    wanted = budget.wants_content(ranked, c, pack.only_tree)
    language = F.col("language") if c.tokens.estimator == "auto" else None
    sizes = texts.join(wanted.where("wanted").select("path", "language"), "path").select("path", T.tokens(F.col("text"), c.tokens.estimator, c.tokens.chars_per_token, language).alias("n"))
    wanted = wanted.join(sizes, "path", "left").withColumn("tokens", F.when(F.col("wanted"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")).drop("n")
    fit = budget.greedy(wanted.where("wanted"), c.max_tokens, free="is_seed").select("path", "included")
    out = wanted.join(fit, "path", "left").withColumn("included", F.coalesce("included", F.lit(False)))
    out = out.withColumns({"omitted_reason": F.when(F.col("wanted") & ~F.col("included"), "token budget exceeded").otherwise(F.col("omitted_reason")), "tokens": F.when(F.col("included"), F.col("tokens")).otherwise(0)})
    pack.candidates = cut(out, "candidates")
    pack.rows = [r.asDict() for r in pack.candidates.orderBy("rank").collect()]
    pack.total_tokens = sum(r["tokens"] for r in pack.rows)
    pack.texts = {r.path: r.text for r in texts.join(pack.candidates.where("included").select("path"), "path").collect()}
    pack.imports = [tuple(r) for r in report.import_counts(edges, pack.candidates).collect()]
    done("content_read")
    return pack


def _llm(pack: Pack, seeds: DataFrame, texts: DataFrame, done) -> None:
    c, focused = pack.config, pack.mode == "focused"
    own = seeds.select(F.col("file").alias("path")).distinct()
    ranked = ranking.rank_context(pack.files, pack.edges, own, pack.mode)
    rows = cut(ranked.join(pack.files.select("path", "language", "kind", "content_policy"), "path").join(own.withColumn("seed", F.lit(True)), "path", "left").withColumn("is_seed", F.coalesce("seed", F.lit(False))).drop("seed"), "ranked")
    done("rank_context")
    first = budget.modes(rows, ranking.order(), c.max_tokens, focused)
    pack.target = c.max_tokens or budget.TARGET
    outlines = cut(extract.outlines(pack.files, texts).withColumn("n_symbols", F.size("classes") + F.size("functions")), "outlines")
    both = first.join(rows, "path").join(outlines.select("path", "n_symbols", F.col("token_estimate").alias("outline_tokens")), "path", "left").fillna(0, ["n_symbols", "outline_tokens"])
    settled = budget.settle(both, [F.length("item_id"), F.col("item_id")], pack.target)
    items = cut(both.drop("content_mode").join(settled, "path"), "items")
    done("budget_allocation")
    pack.candidates = items
    notes = {r.path: r.asDict() for r in outlines.join(items.where("content_mode IN ('excerpt', 'outline')").select("path"), "path").collect()}
    pack.items = [r.asDict() | {"outline": notes.get(r.path, {})} for r in items.orderBy(F.length("item_id"), "item_id").collect()]
    pack.total_tokens = pack.items[-1]["actual"] if pack.items else 0
    pack.texts = {r.path: r.text for r in texts.join(items.where("content_mode = 'full'").select("path"), "path").collect()}
    pack.relations = [r.asDict() for r in report.relation_groups(pack.edges, items).orderBy("src", "dst", "kind").collect()]
    w = report.warnings(items).first()
    pack.warnings = [t for n, t in ((w.n_empty_excerpts, f"{w.n_empty_excerpts} excerpts are empty"), (w.n_unknown_roles, f"{w.n_unknown_roles} files have no known role")) if n]


def build_and_write_pack(spark: SparkSession, paths, graph_html: bool = True, **kwargs) -> tuple[Pack, str]:
    """Build a pack and write its report, ``-`` meaning standard output, and the graph's page beside it."""
    pack = build_pack(spark, paths, **kwargs)
    text, to = pack.render(), pack.config.output
    if to == "-":
        print(text)
        return pack, to
    target = pack.root / to
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    if graph_html and pack.config.emit_graph_html:
        (target.parent / "graph.html").write_text(exports.graph_html(exports.graph_payload(pack.edges, pack.files, pack.candidates)))
    return pack, str(target)


__all__ = ["Pack", "build_and_write_pack", "build_pack"]
