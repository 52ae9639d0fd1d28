"""Edges as JSON, DOT, Mermaid and a page of HTML. Rows are formatted by Spark and written in order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLES = {"config_refs_code": "dotted", "doc_mentions_code": "dotted", "env_key": "dotted", "same_package": "dashed", "test_of": "dashed"}
FIELDS = ("source", "target", "kind", "weight", "confidence", "evidence", "line", "analyzer")


def node_id(path) -> F.Column:
    return F.concat(F.lit("n_"), F.regexp_replace(path, r"[^A-Za-z0-9]", "_"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst", "kind")


def _lines(df: DataFrame, column: str) -> list[str]:
    return [r[0] for r in df.select(column).collect()]


def graph_json(edges: DataFrame) -> str:
    rows = _ordered(edges).select(F.col("src").alias("source"), F.col("dst").alias("target"), *FIELDS[2:]).collect()
    return json.dumps({"edges": [r.asDict() for r in rows]}, indent=2, ensure_ascii=False)


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct().orderBy("path")


def dot(edges: DataFrame) -> str:
    style = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STYLES.items() for x in p]), F.col("kind")), F.lit("solid"))
    label = F.when(F.col("kind") == "import", "").otherwise(F.concat(F.lit(", label="), _quoted(F.col("kind"))))
    nodes = _nodes(edges).select(F.concat(F.lit("  "), node_id(F.col("path")), F.lit(" [label="), _quoted(F.col("path")), F.lit("];")).alias("s"))
    links = _ordered(edges).select(F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" -> "), node_id(F.col("dst")), F.lit(" [style="), style, label, F.lit("];")).alias("s"))
    return "\n".join(["digraph context {", "  rankdir=LR;", *_lines(nodes, "s"), *_lines(links, "s"), "}"]) + "\n"


def mermaid(edges: DataFrame) -> str:
    arrow = F.when(F.col("kind") == "import", "-->").otherwise(F.concat(F.lit("-. "), F.col("kind"), F.lit(" .->")))
    nodes = _nodes(edges).select(node_id(F.col("path")).alias("id"), "path").groupBy("id").agg(F.min("path").alias("path")).orderBy("id")
    nodes = nodes.select(F.concat(F.lit("  "), F.col("id"), F.lit("["), _quoted(F.col("path")), F.lit("]")).alias("s"))
    links = _ordered(edges).select(F.concat(F.lit("  "), node_id(F.col("src")), F.lit(" "), arrow, F.lit(" "), node_id(F.col("dst"))).alias("s"))
    return "\n".join(["flowchart LR", *_lines(nodes, "s"), *_lines(links, "s")]) + "\n"


def graph_payload(edges: DataFrame, files: DataFrame, included: DataFrame) -> dict:
    """Nodes with their degree, component and cluster, edges with their confidence, and the included paths."""
    from ..operators import graph

    degree = graph.degree(edges, weighted=False).withColumnRenamed("node", "id")
    nodes = graph.clusters(edges, files).withColumnRenamed("path", "id").join(files.select(F.col("path").alias("id"), "language"), "id").join(degree, "id", "left").orderBy("id").collect()
    links = _ordered(edges).select("src", "dst", "kind", "confidence").collect()
    return {
        "nodes": [{"id": r.id, "label": r.id.rsplit("/", 1)[-1], "lang": r.language, "weight": int(r.degree or 0), "component": r.component, "cluster": r.cluster} for r in nodes],
        "edges": [{"s": r.src, "t": r.dst, "k": r.kind, "conf": r.confidence} for r in links],
        "included": sorted(r.path for r in included.select("path").distinct().collect()),
    }


PAGE = """<!doctype html><meta charset="utf-8"><title>Context graph</title>
<h1>Context graph</h1><p id="n"></p><table border="1"><thead><tr><th>file<th>language<th>links<th>cluster<th>included</thead><tbody id="b"></tbody></table>
<script>const g = __DATA__; const inc = new Set(g.included);
document.getElementById("n").textContent = g.nodes.length + " files, " + g.edges.length + " links";
for (const x of [...g.nodes].sort((a, b) => b.weight - a.weight)) { const r = document.getElementById("b").insertRow();
for (const v of [x.id, x.lang, x.weight, x.cluster, inc.has(x.id) ? "yes" : ""]) r.insertCell().textContent = v; }</script>
"""


def graph_html(payload: dict) -> str:
    return PAGE.replace("__DATA__", json.dumps(payload, ensure_ascii=False).replace("</", "<\\/"))
