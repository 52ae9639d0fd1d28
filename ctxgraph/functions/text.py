"""Scalar functions: token estimates, stems, test and role predicates, mentions, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

#: Characters (or bytes) of a token, by language.
DENSITY = {lang: ratio for ratio, langs in {
    3.0: "html", 3.4: "json", 3.5: "javascript typescript", 3.6: "rust toml yaml", 3.7: "c cpp go",
    3.8: "markdown python", 3.9: "java kotlin", 4.0: "ini", 4.2: "rst text",
}.items() for lang in langs.split()}
PLAIN = 4.0


def _ratio(language: Column | None, otherwise: float) -> Column:
    if language is None:
        return F.lit(otherwise)
    table = F.create_map(*[F.lit(x) for pair in sorted(DENSITY.items()) for x in pair])
    return F.coalesce(F.element_at(table, F.lower(language)), F.lit(otherwise))


def _divided(size: Column, ratio: Column) -> Column:
    return F.when(size <= 0, 0).otherwise(F.greatest(F.lit(1), (size / ratio).cast("long"))).cast("long")


def tokens(text: Column, estimator: str | None = None, chars_per_token: float = 4.0, language: Column | None = None) -> Column:
    """Estimated tokens of a text by its code points. ``chars``: a fixed ratio; ``auto``: by language (the fixed ratio for
    one that isn't known); else a quarter. Null and empty texts have none, others at least one."""
    size = F.coalesce(F.length(text), F.lit(0))
    if estimator == "chars":
        return _divided(size, F.lit(float(chars_per_token) if chars_per_token > 0 else PLAIN))
    if estimator == "auto":
        return _divided(size, _ratio(language, float(chars_per_token or PLAIN)))
    return _divided(size, F.lit(PLAIN))


def tokens_from_bytes(size: Column, language: Column | None = None, estimator: str | None = None, chars_per_token: float = 4.0) -> Column:
    size = F.coalesce(size, F.lit(0))
    if estimator == "chars":
        return _divided(size, F.lit(float(chars_per_token) if chars_per_token > 0 else PLAIN))
    return _divided(size, _ratio(language, PLAIN))


def exact_tokens(df, text: str = "text", out: str = "n_tokens", vocabulary=None, pattern: str | None = None):
    """Exact byte-level BPE counts with a vocabulary of ranks, where the caller has one (a path to a rank file)."""
    import pyarrow as pa

    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = pa.array([len(own.encode_ordinary(x.as_py() or "")) for x in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), n], names=[*kept, out])

    return df.mapInArrow(run, schema)


def bare_stem(stem: Column) -> Column:
    """Of an indexed file: letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(stem), r"(?U)[^\p{L}\p{N}]", "")


def tested_stem(stem: Column) -> Column:
    """Of a test file: without its test markers, wherever they stand; underscores stay."""
    out = F.lower(stem)
    for mark in ("test_", "_test", ".test"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def related_stem(stem: Column) -> Column:
    return F.replace(F.replace(F.lower(stem), F.lit("test_"), F.lit("")), F.lit("_test"), F.lit(""))


def names_related(a: Column, b: Column) -> Column:
    """Of two related_stem values."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def is_test(path: Column, roots=("tests", "test")) -> Column:
    """A folder of it is a test root, or its name says so."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, roots))) | _test_name(F.lower(paths.name(path))) if roots else _test_name(F.lower(paths.name(path)))


def _test_name(name: Column) -> Column:
    return F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | F.endswith(name, F.lit(".test.py"))


def is_test_name(name: Column) -> Column:
    """The relation's own rule: by name alone, with ``.test.`` anywhere."""
    low = F.lower(name)
    return F.startswith(low, F.lit("test_")) | F.endswith(low, F.lit("_test.py")) | low.contains(".test.")


ROLES = {
    "config": 82, "docs": 35, "entrypoint": 95, "generated": 5, "graph": 90, "language_adapter": 65, "model": 88,
    "native_adapter": 65, "orchestrator": 95, "ranker": 90, "renderer": 90, "scanner": 75, "support": 45, "test": 55, "unknown": 20,
}


def role(path: Column, kind: Column, language: Column) -> Column:
    """What a file is for, by its path in lower case; the first rule that holds."""
    p = F.lower(path)
    has = p.contains
    rules = [
        ("entrypoint", p.rlike(r"\A(?:(?:src/)?main\.py|(?:src/[^/]+/)?cli/main\.py)\z")),
        ("orchestrator", has("orchestrator") | has("pack.py") | has("build.py")),
        ("model", has("model.py") | has("core/models.py")),
        ("config", has("config.py")),
        ("test", (kind == "code") & is_test(p)),
        ("language_adapter", has("languages/")),
        ("graph", has("graph/")),
        ("ranker", has("scorer.py") | has("ranker.py")),
        ("renderer", has("llm_report") | has("renderer")),
        ("scanner", has("scanner/")),
        ("native_adapter", F.endswith(p, F.lit("native.py")) | p.rlike(r"rust/[^/]*native/") | (has("native") & (language == "rust"))),
        ("docs", has("readme") | F.startswith(p, F.lit("docs"))),
        ("support", p.isin("cargo.toml", "package.json", "pyproject.toml") | (kind == "support")),
    ]
    out = F.lit("unknown")
    for value, test in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def role_score(role_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), role_)


def mention_regex(needle: Column) -> Column:
    """A whole-word search for a literal: not after a word character, dot, slash or hyphen, nor before a word character."""
    return F.concat(F.lit(r"(?U)(?<![\w./-])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))


def mentions(text: Column, needle: Column) -> Column:
    """Whether a text mentions a name as a whole word; a needle with a slash counts wherever it stands."""
    return F.when(needle.contains("/"), text.contains(needle)).otherwise(text.contains(needle) & F.regexp_like(text, mention_regex(needle)))


def fence(text: Column) -> Column:
    """Backticks that enclose a text safely: one more than its longest run, three at least."""
    runs = F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
