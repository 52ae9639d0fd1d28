"""Paths as columns, and glob patterns compiled to one anchored regular expression each.

A path is relative, with ``/`` between its parts; the parent of a file at the root is ``.``. A name that begins with a
dot and has no other has no suffix; only the last suffix counts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+(\.[^./]+)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:(?<=[^/])\.[^./]+)?\z", 1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")


def under(path: Column, folder: Column) -> Column:
    """Whether ``path`` lies below ``folder`` (at any depth); everything but itself lies below ``.``."""
    return F.when(folder == ".", path != ".").otherwise(F.startswith(path, F.concat(folder, F.lit("/"))))


def with_path_columns(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.withColumns({"name": name(p), "stem": stem(p), "suffix": F.lower(suffix(p)), "parent": parent(p)})


def _translate(glob: str, star: str = ".*", any_one: str = ".") -> str:
    """A shell pattern as a regular expression; ``star`` is what ``*`` stands for."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if not out or out[-1] != star:
                out.append(star)
        elif c == "?":
            out.append(any_one)
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i : i + 1] == "!" else i + 1)
            if end < 0:
                out.append(r"\[")
            else:
                inside = re.sub(r"[\\\[]|&(?=&)", r"\\\g<0>", glob[i:end])
                out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def glob_regex(pattern: str) -> str | None:
    """One anchored regular expression for a glob, None for one that matches nothing.

    Equality; ``X/**`` means X and all below it from the root, and nothing else; ``*`` crosses slashes in a match of the
    whole path; a pattern without a slash also tries the name; ``**/`` may be left out, for the path and the name; and
    last the pattern may match the last parts of the path, part by part.
    """
    pattern = "/".join(pattern.split("\\")).strip()
    if not pattern:
        return None
    pattern = pattern[1:] if pattern.startswith("/") else pattern
    pattern = pattern.strip("/") if pattern.endswith("/") else pattern
    forms = [re.escape(pattern)]
    if pattern.endswith("/**"):
        forms.append(re.escape(pattern[:-3].strip("/")) + "(?:/.*)?")
    elif pattern:
        forms.append(_translate(pattern))
        if "/" not in pattern:
            forms.append("(?:.*/)?" + _translate(pattern, "[^/]*", "[^/]"))
        if pattern.startswith("**/"):
            forms.append(_translate(pattern[3:]))
            forms.append("(?:.*/)?" + _translate(pattern[3:], "[^/]*", "[^/]"))
        forms.append("(?:.*/)?" + "/".join(_translate(part, "[^/]*", "[^/]") for part in pattern.split("/") if part not in ("", ".")))
    return r"(?s)\A(?:" + "|".join(dict.fromkeys(forms)) + r")\z"


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")


def matches(path: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else path.rlike(regex)


def matches_any(path: Column, patterns) -> Column:
    """One regular expression for all patterns, so that a row is tested once."""
    found = [r for r in map(glob_regex, patterns) if r]
    return path.rlike("|".join(found)) if found else F.lit(False)


def parse_ignore_file(text: str) -> list[tuple[bool, str]]:
    """(negated, pattern) of the lines of an ignore file."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            line = line[negated:].strip()
            if line:
                out.append((negated, line))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The last rule that matches decides; a negated one keeps the path."""

    def one(pattern: str) -> Column:
        pattern = "/".join(pattern.split("\\")).strip().removeprefix("/")
        if pattern.endswith("/"):
            folder = pattern.strip("/")
            return (path == folder) | F.startswith(path, F.lit(folder + "/"))
        if "/" not in pattern:
            regex = r"(?s)\A" + _translate(pattern) + r"\z"
            return F.exists(F.split(path, "/"), lambda part: part.rlike(regex))
        return matches(path, pattern)

    return reduce(lambda so_far, rule: F.when(one(rule[1]), F.lit(not rule[0])).otherwise(so_far), rules, F.lit(False))
