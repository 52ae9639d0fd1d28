"""Packs as Markdown, plain text and a report for language models."""

from __future__ import annotations

import re

BRANCH, LAST, DOWN, GAP = "├── ", "└── ", "│   ", "    "


def tree_text(paths) -> str:
    """Paths as a drawn tree, folders and files in order of name."""
    top: dict = {}
    for p in sorted(set(paths)):
        node = top
        for part in p.split("/"):
            node = node.setdefault(part, {})
    out: list[str] = []
    stack = [(top, "", iter(sorted(top)))]
    while stack:
        node, lead, names = stack[-1]
        name = next(names, None)
        if name is None:
            stack.pop()
            continue
        last = name == max(node)
        out.append(lead + (LAST if last else BRANCH) + name)
        if node[name]:
            stack.append((node[name], lead + (GAP if last else DOWN), iter(sorted(node[name]))))
    return "\n".join(out)


def fence(text: str) -> str:
    return "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))


def cell(text: str) -> str:
    return text.translate({ord("|"): r"\|", ord("\n"): " "})


def numbered(text: str, item: str, language: str) -> str:
    """Lines with four-digit numbers; in Python an anchor before each class and function."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*(?:async\s+)?(?:class|def)\s+(\w+)", line) if language == "python" else None
        if m:
            out.append(f"# @{item}:{m[1]}")
        out.append(f"{n:04d} {line}")
    return "\n".join(out)


def _head(pack) -> list[tuple[str, str]]:
    return [("Root", str(pack.root)), ("Mode", pack.mode), ("Seeds", ", ".join(pack.seeds) or "-"), ("Files", str(len(pack.rows))), ("With content", str(sum(r["included"] for r in pack.rows))), ("Tokens", str(pack.total_tokens))]


def markdown(pack) -> str:
    out = ["# Context pack", "", *[f"- {k}: {v}" for k, v in _head(pack)], "", "## Tree", "", "```", tree_text(r["path"] for r in pack.rows), "```", "", "## Files", "", "| File | Kind | Score | Why | Content |", "|-|-|-|-|-|"]
    out += [f"| {cell(r['path'])} | {r['kind']} | {r['score']} | {cell(r['reason_summary'])} | {'yes' if r['included'] else cell(r['omitted_reason'] or '')} |" for r in pack.rows]
    if pack.imports:
        out += ["", "## Imports", "", *[f"- {side} {path}: {n}" for side, path, n in pack.imports]]
    if not pack.only_tree:
        out += ["", "## Contents"]
        for r in pack.rows:
            if r["included"]:
                text = pack.texts.get(r["path"], "")
                f = fence(text)
                out += ["", f"### {r['path']}", "", f + (r["language"] if r["language"] != "text" else ""), text.rstrip("\n"), f]
    return "\n".join(out) + "\n"


def plain(pack) -> str:
    out = [f"{k}: {v}" for k, v in _head(pack)] + ["", tree_text(r["path"] for r in pack.rows), ""]
    out += [f"{r['score']:>3} {r['path']}: {r['reason_summary']}" + ("" if r["included"] else f" ({r['omitted_reason']})") for r in pack.rows]
    if not pack.only_tree:
        for r in pack.rows:
            if r["included"]:
                out += ["", "=" * 8 + " " + r["path"], pack.texts.get(r["path"], "").rstrip("\n")]
    return "\n".join(out) + "\n"


def llm(pack) -> str:
    """Items by rank with their mode, relations between them, outlines and numbered contents."""
    ids = {i["path"]: i["item_id"] for i in pack.items}
    out = ["# Context for a language model", "", f"Target {pack.target} tokens, used {pack.total_tokens}."]
    out += [f"Warning: {w}" for w in pack.warnings]
    out += ["", "## Tree", "", "```", tree_text(ids), "```", "", "## Items", "", "| Id | File | Role | Score | Mode |", "|-|-|-|-|-|"]
    out += [f"| {i['item_id']} | {cell(i['path'])} | {i['role']} | {i['score']} | {i['content_mode']} |" for i in pack.items]
    if pack.relations:
        out += ["", "## Relations", "", *[f"- {ids[r['src']]} -> {ids[r['dst']]} {r['kind']} x{r['n']} ({r['confidence']:.2f}; {r['analyzers']})" for r in pack.relations]]
    for i in pack.items:
        if i["content_mode"] == "full":
            text = numbered(pack.texts.get(i["path"], ""), i["item_id"], i["language"])
            f = fence(text)
            out += ["", f"## {i['item_id']} {i['path']}", "", f, text, f]
        elif i["content_mode"] in ("excerpt", "outline"):
            o = i["outline"]
            out += ["", f"## {i['item_id']} {i['path']} ({i['content_mode']})", "", *[f"- {k}: {', '.join(o[k])}" for k in ("imports", "classes", "functions", "notes") if o.get(k)]]
    return "\n".join(out) + "\n"
