"""Settings: defaults, TOML files, profiles and overrides (in this order), validation and the hash of what a scan depends on."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

SECTION = "ctxgraph"


def _every(text: str) -> list[str]:
    return [f"**/*.{x}" for x in text.split()]


def _both(stem: str) -> list[str]:
    return [f"{stem}.yaml", f"{stem}.yml"]


CODE = _every("astro c cpp css go h hpp htm html java js jsx kt less py pyi rs sass scss svelte ts tsx vue")
_LOCKS = "Cargo.lock Pipfile.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock uv.lock yarn.lock".split()
_COMPOSE = _both("docker-compose")
_TOOLS = ".ruff.toml mypy.ini pytest.ini pyproject.toml requirements.txt requirements/*.txt ruff.toml tox.ini".split()
_SHARED = [".env.example", ".env.template", *_both(".github/workflows/*"), "Cargo.toml", "Dockerfile", "Dockerfile.*", "README.md", "go.mod", *_COMPOSE, *_TOOLS]
SUPPORT = sorted({
    *_every("json lock svg toml"), *_LOCKS, *_SHARED, *_both("compose"), *(f"config/*.{x}" for x in "json toml yaml yml".split()), *(f"settings/*.{x}" for x in "toml yaml yml".split()),
    *".gitlab-ci.yml .pre-commit-config.yaml CHANGELOG.md CONTRIBUTING.md Pipfile README.rst docs/**/*.md package.json setup.cfg setup.py tsconfig.json vite.config.* webpack.config.*".split(),
})
FULL = sorted({*_every("json toml"), *_SHARED})
TREE_ONLY = sorted({*_every("lock svg"), *_LOCKS})
HARD_IGNORE = [f"{x}/**" for x in ".ctxgraph .git .hg .idea .mypy_cache .next .pytest_cache .ruff_cache .svn .turbo .venv __pycache__ build dist env node_modules target venv".split()]

SCORING = {key: points for points, keys in {
    100: "seed_file seed_folder_file", 90: "direct_dependency entrypoint_file", 85: "reverse_dependency", 80: "code_file related_test", 65: "same_package",
    60: "parent_entrypoint support_near_seed test_file", 55: "project_config", 52: "dependency_file", 50: "runtime_support", 45: "documentation name_similarity", 40: "other_file", 10: "shared_dependency_bonus",
}.items() for key in keys.split()}
PROFILES = {
    "audit": {"dependency_file": 90, "documentation": 70, "project_config": 90, "runtime_support": 85, "test_file": 80},
    "debug": {"direct_dependency": 90, "reverse_dependency": 80, "runtime_support": 80, "support_near_seed": 80, "test_file": 70},
    "docs": {"code_file": 30, "dependency_file": 30, "documentation": 95, "project_config": 50, "test_file": 10},
    "refactor": {"direct_dependency": 60, "related_test": 90, "same_package": 80, "test_file": 75},
    "gpt": {}, "focused-gpt": {}, "full": {}, "default": {},
}
LLM_PROFILES = ("gpt", "focused-gpt", "full")


@dataclass(frozen=True)
class Modules:
    content_min_score: int = 50
    tree_min_score: int = 30
    depth: int = 2
    top_dependencies: int = 10
    include_tests: bool = True
    include_direct_dependencies: bool = True
    include_parent_entrypoints: bool = True
    include_project_configs: bool = True
    include_reverse_dependencies: bool = True
    include_same_package: bool = True
    enabled: bool = True
    scoring: dict = field(default_factory=lambda: dict(SCORING))


@dataclass(frozen=True)
class Python:
    source_roots: tuple = ("src", "app", ".")
    test_roots: tuple = ("tests", "test")
    entrypoints: tuple = ("app.py", "asgi.py", "main.py", "router.py", "routes.py", "wsgi.py")


@dataclass(frozen=True)
class Content:
    default: str = "auto"
    full: tuple = tuple(FULL)
    tree_only: tuple = tuple(TREE_ONLY)
    auto_max_bytes: int = 80_000


@dataclass(frozen=True)
class Tokens:
    estimator: str = "chars"
    chars_per_token: float = 4
    encoding: str | None = None


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    dir: str = ".ctxgraph/cache"
    max_entries: int = 50_000


@dataclass(frozen=True)
class Config:
    format: str = "md"
    output: str = ".ctxgraph/pack.md"
    use_gitignore: bool = True
    support: bool = True
    only_tree: bool = False
    modules: bool = True
    max_files: int = 0
    max_tokens: int = 0
    min_score: int = 45
    allow_external_paths: bool = False
    emit_graph_html: bool = True
    code_patterns: tuple = tuple(CODE)
    support_patterns: tuple = tuple(SUPPORT)
    hard_ignore: tuple = tuple(HARD_IGNORE)
    modules_config: Modules = Modules()
    python: Python = Python()
    content: Content = Content()
    tokens: Tokens = Tokens()
    cache: Cache = Cache()

    def score(self, key: str) -> int:
        return int(self.modules_config.scoring.get(key, 0))


_FLAT = ("format", "output", "only_tree", "use_gitignore", "max_files", "max_tokens", "min_score", "allow_external_paths", "emit_graph_html")


def _take(default, table: dict):
    """A dataclass with the values that a TOML table gives for its fields, coerced to their kinds."""
    out = {}
    for k, old in asdict(default).items():
        if k in table and k != "scoring":
            new = table[k]
            out[k] = tuple(map(str, new)) if isinstance(old, tuple) else new if old is None else type(old)(new)
    return replace(default, **out)


def from_toml(text: str) -> Config:
    """Settings of the ``[tool.ctxgraph]`` table. Empty lists of content patterns get the defaults."""
    t = tomllib.loads(text).get("tool", {}).get(SECTION, {})
    c = Config(**{k: type(getattr(Config(), k))(t[k]) for k in _FLAT if k in t})
    modules = t.get("modules", {})
    support = t.get("support_files", {})
    content = {k: v for k, v in support.get("content", {}).items() if not (k in ("full", "tree_only") and not v)}
    own = _take(c.modules_config, modules)
    return replace(
        c, modules=bool(modules.get("enabled", True)), support=bool(support.get("enabled", True)),
        code_patterns=tuple(t.get("code_files", {}).get("patterns") or CODE), support_patterns=tuple(support.get("patterns") or SUPPORT),
        hard_ignore=tuple(t.get("hard_ignore", {}).get("patterns") or HARD_IGNORE),
        modules_config=replace(own, scoring={**SCORING, **{k: int(v) for k, v in modules.get("scoring", {}).items()}}),
        python=_take(c.python, t.get("python", {})), content=_take(c.content, content), tokens=_take(c.tokens, t.get("tokens", {})), cache=_take(c.cache, t.get("cache", {})),
    )


def with_profile(c: Config, profile: str | None) -> Config:
    if not profile:
        return c
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; one of {', '.join(sorted(PROFILES))}")
    c = replace(c, modules_config=replace(c.modules_config, scoring={**c.modules_config.scoring, **PROFILES[profile]}))
    return replace(c, content=replace(c.content, default="tree_only")) if profile == "docs" else c


def with_overrides(c: Config, support_content: str | None = None, **values) -> Config:
    """Those values that aren't None win over everything else."""
    c = replace(c, **{k: v for k, v in values.items() if v is not None})
    return replace(c, content=replace(c.content, default=support_content)) if support_content else c


def scan_hash(c: Config) -> str:
    """Of the settings that a scan and its relations depend on."""
    seen = {k: getattr(c, k) for k in ("code_patterns", "hard_ignore", "support", "support_patterns", "use_gitignore")}
    seen |= {"content": asdict(c.content), "python": asdict(c.python)}
    return hashlib.sha256(json.dumps(seen, sort_keys=True, default=list).encode()).hexdigest()


def validate(c: Config) -> list[tuple[str, str]]:
    """(severity, message) of everything that is wrong; ``error`` makes the settings unusable."""
    out = []
    need = lambda ok, text, kind="error": None if ok else out.append((kind, text))
    need(c.format in ("md", "txt"), f"format {c.format!r} is neither md nor txt")
    need(c.content.default in ("auto", "full", "tree_only"), f"support content {c.content.default!r} is none of auto, full, tree_only")
    need(c.tokens.estimator in ("auto", "chars"), f"token estimator {c.tokens.estimator!r} is unknown; a quarter of the length is used", "warning")
    for k in ("max_files", "max_tokens"):
        need(getattr(c, k) >= 0, f"{k} is negative")
    need(0 <= c.min_score <= 100, "min_score is outside 0 to 100")
    need(c.modules_config.depth >= 0, "depth is negative")
    need(c.modules_config.top_dependencies >= 0, "top_dependencies is negative")
    need(c.tokens.chars_per_token > 0, "chars_per_token isn't positive; 4 is used", "warning")
    need(c.content.auto_max_bytes >= 0, "auto_max_bytes is negative")
    need(c.cache.max_entries >= 0, "cache.max_entries is negative")
    need(bool(c.code_patterns), "no code patterns", "warning")
    for k, v in c.modules_config.scoring.items():
        need(k in SCORING, f"scoring key {k!r} is unknown", "warning")
        need(0 <= v <= 100, f"score {k} = {v} is outside 0 to 100", "warning")
    need(c.modules_config.tree_min_score <= c.modules_config.content_min_score, "tree_min_score is above content_min_score", "warning")
    return out


def find_file(start: Path, cwd: Path | None = None) -> Path | None:
    """The nearest pyproject.toml from ``start`` upward, then from the working directory."""
    for base in (Path(start).resolve(), (cwd or Path.cwd()).resolve()):
        for folder in [base, *base.parents] if base.is_dir() else base.parents:
            if (folder / "pyproject.toml").is_file():
                return folder / "pyproject.toml"
    return None


INIT = f"""[tool.{SECTION}]
format = "md"
max_files = 0
max_tokens = 0
min_score = 45

[tool.{SECTION}.modules]
enabled = true
depth = 2
top_dependencies = 10

[tool.{SECTION}.support_files]
enabled = true

[tool.{SECTION}.tokens]
estimator = "chars"
chars_per_token = 4
"""


def init_text(text: str, force: bool = False) -> str:
    """A TOML text with the section of our own appended, or replaced where it is there and ``force`` holds."""
    lines = text.splitlines(keepends=True)
    own = lambda s: s.strip().startswith((f"[tool.{SECTION}]", f"[tool.{SECTION}.", f"[[tool.{SECTION}."))
    if any(map(own, lines)):
        if not force:
            raise ValueError(f"[tool.{SECTION}] is there already")
        kept, inside = [], False
        for line in lines:
            if line.lstrip().startswith("["):
                inside = own(line)
            if not inside:
                kept.append(line)
        lines = kept
    before = "".join(lines).rstrip()
    return (before + "\n\n" if before else "") + INIT
