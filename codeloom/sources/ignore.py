"""Ignore rules: the documented forms of ignore files as regular expressions, decided for paths in DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    directory_only: bool
    line: int


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            held = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + held[1:] if held[0] == "!" else held) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def compile_rules(text: str) -> tuple[list[Rule], list[tuple[int, str]]]:
    """(rules in order, problems by line) of an ignore file's text."""
    rules, problems = [], []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        directory_only = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        if not body:
            problems.append((number, "empty pattern"))
            continue
        regex = f"^{'' if anchored else '(?:.*/)?'}{_glob(body)}$"
        try:
            re.compile(regex)
        except re.error as e:
            problems.append((number, str(e)))
            continue
        rules.append(Rule(regex, negated, directory_only, number))
    return rules, problems


def _decided(prefix: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """The last rule that matches decides; a directory named .git is always ignored."""
    out = F.when(is_dir & prefix.rlike(r"(?:^|/)\.git$"), True)
    for r in reversed(rules):
        hit = prefix.rlike(r.regex)
        out = out.when(hit & is_dir if r.directory_only else hit, not r.negated)
    return out.otherwise(False)


def is_ignored(path: str, rules: list[Rule]) -> Column:
    """Whether a file's path is ignored: the first ignored ancestor, or the file itself."""
    parts = F.split(F.col(path), "/")
    return F.exists(F.sequence(F.lit(1), F.size(parts)), lambda k: _decided(F.array_join(F.slice(parts, F.lit(1), k), "/"), k < F.size(parts), rules))
