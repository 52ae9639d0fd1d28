"""Command line: select, explain and export context of a source tree."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import config as settings

CHOICES = {"--format": "md txt", "--path-base": "cwd project", "--support-content": "auto full tree_only"}
OK, INVALID, USER, INTERRUPTED = 0, 1, 2, 130


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxgraph", description=__doc__)
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--profile", choices=sorted(settings.PROFILES))
    p.add_argument("--config")
    for name in ("modules", "support", "only-tree"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    for name in ("max-files", "max-tokens", "min-score"):
        p.add_argument(f"--{name}", type=int)
    for name, values in CHOICES.items():
        p.add_argument(name, choices=values.split(), default="project" if name == "--path-base" else None)
    p.add_argument("--project", action="store_true")
    p.add_argument("--output")
    for name in ("dry-run", "timings", "explain", "explain-selection", "explain-graph", "init", "force", "validate-config", "no-graph-html", "version"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--why", metavar="FILE")
    for name in ("json", "html", "dot", "mermaid"):
        p.add_argument(f"--graph-{name}", metavar="FILE")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a, spark)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USER
    except KeyboardInterrupt:
        return INTERRUPTED


def _run(a, spark) -> int:
    if a.version:
        print("ctxgraph 0.1")
        return OK
    if a.init:
        target = Path(a.config or "pyproject.toml")
        target.write_text(settings.init_text(target.read_text() if target.is_file() else "", a.force))
        return OK
    if a.validate_config:
        from .pack import load_config

        found = settings.validate(load_config(a.paths, a.config, a.profile)[0])
        for kind, text in found:
            print(f"{kind}: {text}")
        return INVALID if any(k == "error" for k, _ in found) else OK
    from pyspark.sql import SparkSession

    from . import pack as packs
    from .operators import graph, ranking, report, scoring
    from .render import exports
    from .session import ship

    spark = spark or SparkSession.builder.appName("ctxgraph").getOrCreate()
    ship(spark)
    same = "profile output max_files max_tokens min_score modules only_tree path_base project support support_content"
    options = {k: getattr(a, k) for k in same.split()} | {"config_path": a.config, "output_format": a.format}
    looking = a.dry_run or a.explain_graph or a.why or any((a.graph_json, a.graph_html, a.graph_dot, a.graph_mermaid))
    err = lambda *x: print(*x, file=sys.stderr)
    if looking:
        pack = packs.build_pack(spark, a.paths, **options)
    else:
        pack, to = packs.build_and_write_pack(spark, a.paths, not a.no_graph_html, **options)
        if to != "-":
            err(f"wrote {to}")
    for to, make in ((a.graph_json, exports.graph_json), (a.graph_dot, exports.dot), (a.graph_mermaid, exports.mermaid), (a.graph_html, lambda e: exports.graph_html(exports.graph_payload(e, pack.files, pack.candidates)))):
        if to:
            Path(to).write_text(make(pack.edges))
    if a.dry_run or a.explain or a.explain_selection:
        for r in pack.rows or pack.items:
            err(f"{r['score']:>3} {r['path']} {r.get('reason_summary') or r.get('content_mode')}")
    if a.explain_graph:
        s = graph.stats(pack.edges).first()
        err(f"edges {s.edges}, nodes {s.nodes}, average degree {s.avg_degree:.2f}")
        for title, df in (("kinds", graph.kind_histogram(pack.edges).orderBy("kind")), ("cycles", graph.cycles(pack.edges).orderBy("scc")), ("hubs", graph.degree(pack.edges).orderBy(scoring.F.desc("degree"), "node").limit(5)), ("pagerank", graph.pagerank(pack.edges).orderBy(scoring.F.desc("rank"), "node").limit(5)), ("layers", report.layer_preview(graph.topological_layers(pack.edges)).orderBy("layer"))):
            err(title)
            for r in df.collect():
                err("  " + " ".join(map(str, r)))
    if a.why:
        order = ranking.order() if pack.items else scoring.order()
        found, links = report.why(pack.candidates, pack.edges, a.why, order)
        row = found.first()
        if row is None:
            err(f"no candidate holds {a.why!r}")
            return USER
        err(f"{row.path}: score {row.score}")
        for e in links.collect():
            err(f"  {e.kind} from {e.src} ({e.analyzer}: {e.evidence or '-'})")
    if a.timings:
        for k, v in pack.timings.items():
            err(f"{k}: {v:.2f} s")
    return OK


if __name__ == "__main__":
    sys.exit(main())
