"""Classified files: language, kind, support category, content policy, binary test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import paths

LANGUAGES = {x: lang for lang, suffixes in {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "go": "go", "ini": "cfg ini", "java": "java", "javascript": "js jsx", "json": "json", "kotlin": "kt",
    "lock": "lock", "markdown": "md", "python": "py pyi", "rst": "rst", "rust": "rs", "text": "txt", "toml": "toml", "typescript": "ts tsx", "yaml": "yaml yml",
}.items() for x in suffixes.split()}
TEXT = frozenset("astro bash bat c cc cfg cmd cpp css cxx fish go h hh hpp htm html hxx ini java js json jsx kt less lock md ps1 py pyi rs rst sass scss sh svelte toml ts tsx txt vue yaml yml zsh".split())
BINARY = frozenset("7z a avi bmp bz2 class dll dylib eot exe flac flv gif gz ico jpeg jpg lib mkv mov mp3 mp4 msi o obj ogg otf pdb pdf png pyc pyd pyo rar so tar tgz tif tiff ttf wasm wav webp woff woff2 xz zip".split())
SNIFF = 4096

_CONFIG_NAMES = ["mypy.ini", "pytest.ini", "setup.cfg", "setup.py", "tox.ini"]
_DEPENDENCY_NAMES = ["Cargo.toml", "Pipfile", "go.mod", "go.sum", "package-lock.json", "package.json", "pnpm-lock.yaml", "requirements.txt"]


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in sorted(LANGUAGES.items()) for x in ("." + k, v)])
    return F.when(F.startswith(paths.name(path), F.lit("Dockerfile")), "dockerfile").otherwise(F.coalesce(F.element_at(table, F.lower(paths.suffix(path))), F.lit("text")))


def support_category(path: Column) -> Column:
    """The first rule that holds; any TOML file counts as project configuration."""
    name = paths.name(path)
    starts = lambda c, *xs: c.rlike(r"\A(?:" + "|".join(xs) + ")")
    return (
        F.when(F.endswith(name, F.lit(".toml")) | name.isin(_CONFIG_NAMES), "project config")
        .when(F.endswith(name, F.lit(".lock")) | name.isin(_DEPENDENCY_NAMES) | starts(path, "requirements/"), "dependency file")
        .when(starts(name, "README") | name.isin("CHANGELOG.md", "CONTRIBUTING.md") | starts(path, "docs/"), "documentation")
        .when(starts(name, "Dockerfile", "docker-compose", "compose"), "runtime support")
        .when(starts(path, r"\.github/workflows/") | (name == ".gitlab-ci.yml"), "ci support")
        .when(starts(name, r"\.env") | starts(path, "config/", "settings/"), "runtime config")
        .when(name.isin("tsconfig.json", ".pre-commit-config.yaml") | starts(name, r"vite\.config", r"webpack\.config"), "tooling config")
        .otherwise("support file")
    )


def content_policy(path: Column, config: Config) -> Column:
    c = config.content
    return F.when(paths.matches_any(path, c.tree_only), "tree_only").when(paths.matches_any(path, c.full), "full").otherwise(c.default)


def is_binary(path: Column, head: Column | None = None) -> Column:
    """By extension where that tells; else a zero byte among the first 4096. Without content: false."""
    ext = F.regexp_extract(F.lower(paths.suffix(path)), r"\A\.(.*)\z", 1)
    zero = F.lit(False) if head is None else F.coalesce(F.contains(F.hex(F.substring(head, 1, SNIFF)), F.lit("00")) & (F.position(F.lit(b"\x00"), F.substring(head, 1, SNIFF)) > 0), F.lit(True))
    return F.when(ext.isin(*sorted(TEXT)), False).when(ext.isin(*sorted(BINARY)), True).otherwise(zero)


def lossy_text(content: Column) -> Column:
    """Bytes as text, with U+FFFD where they aren't UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def readable(path: Column, content: Column) -> Column:
    return ~is_binary(path, content) & F.is_valid_utf8(content.cast("string"))


def classify(files: DataFrame, config: Config = Config(), ignore: list | None = None) -> DataFrame:
    """Files that a code or support pattern names, with kind, language, support_category and content_policy; the
    hard-ignored and (with ``ignore`` rules) the ignored ones are left out. Other columns pass through."""
    p = F.col("path")
    code, support = paths.matches_any(p, config.code_patterns), paths.matches_any(p, config.support_patterns) if config.support else F.lit(False)
    kept = files.where(~paths.matches_any(p, config.hard_ignore))
    if ignore and config.use_gitignore:
        kept = kept.where(~paths.ignored(p, ignore))
    kept = kept.withColumn("kind", F.when(code, "code").when(support, "support")).where("kind IS NOT NULL")
    is_support = F.col("kind") == "support"
    return kept.withColumns({
        "language": language(p),
        "support_category": F.when(is_support, support_category(p)),
        "content_policy": F.when(is_support, content_policy(p, config)).otherwise("auto"),
    })
