"""Packs of small source trees, end to end."""

import pytest

from ctxgraph import build_and_write_pack, build_pack, cli
from ctxgraph import config as settings
from ctxgraph import pack as packs
from ctxgraph.operators import extract
from ctxgraph.plans import fixtures
from ctxgraph.render import exports, reports
from ctxgraph.sources import scan

FILES = {
    "src/app/__init__.py": "", "src/app/auth.py": "from .session import Session\nfrom . import config\n\n\nclass Auth(Session):\n    pass\n", "src/app/session.py": "class Session:\n    pass\n",
    "src/app/config.py": "KEY = 1\n", "src/app/unrelated.py": "X = 2\n", "src/app/billing.py": "from app import config\n", "src/app/main.py": "from app.auth import Auth\n", "src/api/routes.py": "from app.auth import Auth\n",
    "tests/test_auth.py": "from app.auth import Auth\n", "README.md": "# x\n", "requirements.txt": "a\n", "poetry.lock": "lock\n", "Dockerfile": "FROM x\n", "node_modules/p/index.js": "x\n", "ignored.tmp": "x\n", ".gitignore": "*.tmp\n", "binary.bin": "\0",
    "pyproject.toml": "[tool.ctxgraph]\nmax_files = 50\nmax_tokens = 100000\nmin_score = 30\n",
}


@pytest.fixture
def tree(tmp_path):
    for p, t in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return tmp_path


def by_path(pack):
    return {r["path"]: r for r in pack.rows}


def test_scan(spark, tree):
    got = {r.path: r for r in scan.scan(spark, tree).collect()}
    assert set(got) == {p for p in FILES if p not in ("node_modules/p/index.js", "ignored.tmp", ".gitignore", "binary.bin")}
    assert got["pyproject.toml"].support_category == "project config" and got["poetry.lock"].content_policy == "tree_only"
    (tree / "odd.py").write_bytes(b"hello \xff world")
    assert {r.path: r.text for r in scan.read_texts(scan.scan(spark, tree)).collect()}["odd.py"] == "hello � world"


def test_listing_in_rounds(spark, tree):
    for k in range(12):
        (tree / f"deep/d{k}/e/f").mkdir(parents=True)
        (tree / f"deep/d{k}/e/f/m.py").write_text("x")
        (tree / f"deep/d{k}/m.py").write_text("xy")
    (tree / "link").symlink_to(tree / "src")
    whole = scan.listing(spark, tree).collect()
    assert sorted(whole) == sorted(scan.listing(spark, tree, most=2).collect())
    want = {str(p.relative_to(tree)): p.stat().st_size for p in tree.rglob("*") if p.is_file() and "node_modules" not in p.parts and "link" not in p.parts}
    assert {r.path: r.size_bytes for r in whole} == want and len(whole) == len(want)
    assert scan.listing(spark, tree / "deep/d1/e").collect()[0].path == "f/m.py"


def test_unchanged_tree_is_restored(spark, tree, monkeypatch):
    """A second run reads no text to relate files; a change of a file or of the settings builds anew."""
    first = build_pack(spark, [tree / "src/app/auth.py"])
    edges = sorted(map(str, first.edges.collect()))
    assert "graph_build" in first.timings and edges
    real, calls = packs.extract.import_edges, []
    monkeypatch.setattr(packs.extract, "import_edges", lambda *a: calls.append(1) or real(*a))
    again = build_pack(spark, [tree / "src/app/auth.py"])
    assert "graph_restore" in again.timings and not calls and sorted(map(str, again.edges.collect())) == edges and again.rows == first.rows
    (tree / "src/app/new.py").write_text("from app import auth\n")
    third = build_pack(spark, [tree / "src/app/auth.py"])
    assert len(calls) == 1 and ("src/app/new.py", "src/app/auth.py") in {(r.src, r.dst) for r in third.edges.collect()}
    (tree / "src/app/new.py").unlink()
    assert len(build_pack(spark, [tree / "src/app/auth.py"]).edges.collect()) == len(edges) and len(calls) == 2
    (tree / "tsconfig.json").write_text("{}")
    assert "graph_build" in build_pack(spark, [tree / "src/app/auth.py"]).timings and len(calls) == 3


def test_focused(spark, tree):
    rows = by_path(build_pack(spark, [tree / "src/app/auth.py"]))
    assert rows["src/app/auth.py"]["score"] == 100
    for p in ("tests/test_auth.py", "src/api/routes.py", "src/app/session.py"):
        assert rows[p]["score"] >= 80
    assert {"README.md", "pyproject.toml", "requirements.txt", "src/app/config.py"} <= set(rows)
    assert "tree_only" in rows["poetry.lock"]["omitted_reason"]


def test_two_seeds_share(spark, tree):
    rows = by_path(build_pack(spark, [tree / "src/app/auth.py", tree / "src/app/billing.py"]))
    assert rows["src/app/config.py"]["score"] == 100 and "shared dependency bonus" in rows["src/app/config.py"]["reason_summary"]


def test_snapshot_and_flags(spark, tree):
    pack = build_pack(spark, [tree])
    rows = by_path(pack)
    assert pack.mode == "project_snapshot"
    assert (rows["src/app/main.py"]["score"], rows["tests/test_auth.py"]["score"], rows["src/app/auth.py"]["score"], rows["README.md"]["score"]) == (90, 60, 80, 45)
    assert rows["src/app/main.py"]["reason_summary"] == "entrypoint file" and rows["README.md"]["reason_summary"] == "project support file"
    assert not any(r["kind"] == "support" for r in build_pack(spark, [tree], support=False).rows)
    bare = build_pack(spark, [tree / "src/app/auth.py"], modules=False)
    assert {"src/app/auth.py", "pyproject.toml"} <= set(by_path(bare)) and "src/app/session.py" not in by_path(bare)
    only = build_pack(spark, [tree], only_tree=True)
    assert not any(r["included"] for r in only.rows) and "## Contents" not in only.render()


def test_llm_and_writing(spark, tree):
    pack, to = build_and_write_pack(spark, [tree / "src/app/auth.py"], profile="focused-gpt")
    assert pack.items[0]["item_id"] == "F001" and {i["path"] for i in pack.items} == {r.path for r in pack.files.collect()}
    modes = {i["path"]: i["content_mode"] for i in pack.items}
    assert modes["src/app/auth.py"] == "full" and modes["poetry.lock"] == "tree"
    assert "class Auth" in open(to).read() and (tree / ".ctxgraph/graph.html").exists()
    links = exports.graph_json(pack.edges)
    assert '"kind": "inherits"' in links and "digraph" in exports.dot(pack.edges) and "-->" in exports.mermaid(pack.edges)


def test_cli(spark, tree, capsys):
    assert cli.main([str(tree / "src/app/auth.py"), "--dry-run", "--why", "session", "--explain-graph", "--timings"], spark) == 0
    err = capsys.readouterr().err
    assert "src/app/session.py: score" in err and "cycles" in err and "graph_build" in err
    assert cli.main([str(tree / "nowhere")], spark) == 2
    assert cli.main(["--version"]) == 0
    (tree / "bad.toml").write_text('[tool.ctxgraph]\nformat = "pdf"\n')
    assert cli.main(["--validate-config", "--config", str(tree / "bad.toml")]) == 1 and cli.main(["--validate-config", "--config", str(tree / "pyproject.toml")]) == 0
    assert cli.main(["--init", "--config", str(tree / "new.toml")]) == 0 and cli.main(["--init", "--config", str(tree / "new.toml")]) == 2
    assert cli.main(["--init", "--force", "--config", str(tree / "new.toml")]) == 0


def test_config():
    c = settings.with_profile(settings.from_toml('[tool.ctxgraph]\nmin_score = 10\n[tool.ctxgraph.tokens]\nestimator = "auto"\nencoding = "x"\n[tool.ctxgraph.modules.scoring]\ncode_file = 70\n'), "docs")
    assert (c.min_score, c.tokens.estimator, c.tokens.encoding, c.score("code_file"), c.score("documentation"), c.content.default) == (10, "auto", "x", 30, 95, "tree_only")
    assert settings.scan_hash(c) != settings.scan_hash(settings.Config()) and settings.scan_hash(c) == settings.scan_hash(settings.with_overrides(c, max_files=3))
    assert len(settings.CODE) == 23 and len(settings.SUPPORT) == 53 and len(settings.FULL) == 21 and len(settings.TREE_ONLY) == 10 and len(settings.HARD_IGNORE) == 18
    with pytest.raises(ValueError):
        settings.with_profile(c, "none")


def test_text_forms():
    assert reports.tree_text(["b/c.py", "a.py", "b/a/x.py"]) == "├── a.py\n└── b\n    ├── a\n    │   └── x.py\n    └── c.py"
    assert reports.fence("a ```` b") == "`````" and reports.numbered("x\nclass A:\n", "F001", "python") == "0001 x\n# @F001:A\n0002 class A:"
    assert fixtures.values(".go").count("(") >= 3


def test_js_aliases():
    read = extract.js_aliases
    assert read('{"compilerOptions": {"paths": {"": ["x"], "@lib/*": ["lib\\\\deep/*"], "~/*": ["y/*"]}}}', '{"imports": {"#u/*": "./util/*", "#o": {"a": 1}, "z": "q"}}') == {"@lib": "lib/deep", "#u": "util/*"}
    for broken in (None, "", "[]", "{", '{"compilerOptions": 3}', '{"compilerOptions": {"paths": []}}', '{"imports": [1]}'):
        assert read(broken, broken) == {}


def test_exact_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken
    from ctxgraph.functions import text as T

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    lib = tiktoken.Encoding("x", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "def f(x): return x", "größer 中文 " * 50]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "k long, text string, n_tokens int")
    got = {r.k: r for r in T.exact_tokens(df, vocabulary=path, pattern=tokenizers.PATTERN).collect()}
    assert [got[i].n_tokens for i in range(4)] == [len(lib.encode_ordinary(t or "")) for t in texts] and list(got[0].asDict()) == ["k", "text", "n_tokens"]
