"""Ignore layers and presets of a workspace: built-in rules, then the user's, then the project's; later layers win."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ignore

# Directories ignored by default, and the marker files of each preset (those without markers are never chosen by themselves).
DEFAULT_DIRECTORIES = (
    ".ai", ".git", ".gradle", ".idea", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vs", "DerivedData", "Pods", "__pycache__", "bin", "build",
    "coverage", "dist", "node_modules", "obj", "out", "target", "venv",
)
PRESETS = {
    "node": ("package.json", "pnpm-lock.yaml", "yarn.lock"),
    "dotnet": ("*.sln", "*.csproj", "*.fsproj", "Directory.Build.props"),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"),
    "python": ("pyproject.toml", "setup.py", "requirements.txt"),
    "go": ("go.mod",),
    "rust": ("Cargo.toml",),
    "swift": ("Package.swift", "*.xcodeproj", "Podfile"),
    "android": ("settings.gradle", "settings.gradle.kts"),
    "php": ("composer.json",),
    "ruby": ("Gemfile",),
    "unity": ("ProjectSettings/ProjectVersion.txt",),
    "ml": ("*.ipynb", "environment.yml"),
    "terraform": ("*.tf",),
    "editors": (),
}


@dataclass
class Layer:
    """One scope's rules: its ignore text, or older entries where it has no text; entries that the text shadows are reported."""

    scope: str
    text: str | None = None
    entries: tuple[str, ...] = ()
    rules: list[ignore.Rule] = field(init=False)
    problems: list[tuple[int, str]] = field(init=False)

    def __post_init__(self):
        self.rules, self.problems = ignore.compile_rules(self.text if self.text is not None else "\n".join(rule_text(e) for e in self.entries))

    @property
    def shadowed(self) -> tuple[str, ...]:
        return tuple(sorted(self.entries)) if self.text is not None else ()


def rule_text(entry: str) -> str:
    """An older entry names a directory anywhere."""
    return entry.strip().rstrip("/") + "/"


def builtin() -> Layer:
    return Layer("built-in", entries=DEFAULT_DIRECTORIES)


def effective(*layers: Layer) -> list[ignore.Rule]:
    """All rules in the order of their layers; the last that matches decides."""
    return [r for layer in (builtin(), *layers) for r in layer.rules]


def added(text: str, patterns: list[str]) -> tuple[str, list[str], list[str]]:
    """(text with the patterns appended, those added, those already there)."""
    present, new, old = {line.strip() for line in text.splitlines()}, [], []
    for p in (p.strip() for p in patterns):
        if not p or "\n" in p:
            raise ValueError(f"not a pattern: {p!r}")
        (old if p in present or p in new else new).append(p)
    lead = text if not text or text.endswith("\n") else text + "\n"
    return lead + "".join(p + "\n" for p in new), new, old


def removed(text: str, patterns: list[str], below: list[ignore.Rule]) -> tuple[str, dict[str, list[str]]]:
    """Deletes own lines; a pattern that other layers ignore is negated; what is in neither is reported."""
    import re

    lines, done = text.splitlines(), {"removed": [], "negated": [], "not_present": []}
    for p in patterns:
        kept = [line for line in lines if line.strip() != p]
        name = p.strip("/")
        hit = [r for r in below if re.match(r.regex, name)]
        if len(kept) < len(lines):
            lines = kept
            done["removed"].append(p)
        elif hit and not hit[-1].negated:
            lines.append("!" + p)
            done["negated"].append("!" + p)
        else:
            done["not_present"].append(p)
    return "".join(line + "\n" for line in lines), done


def detected(files: DataFrame) -> list[str]:
    """Presets whose markers lie at the root or one folder below; paths are filtered in the plan, so few rows come back."""
    depth = F.size(F.split("path", "/"))
    near = files.where(depth <= 3)
    hits = [(name, m) for name, marks in PRESETS.items() for m in marks]
    regex = lambda m: "^(?:[^/]+/)?" + fnmatch.translate(m).replace(".*", "[^/]*").replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$")
    row = near.agg(*[F.coalesce(F.max(F.col("path").rlike(regex(m))), F.lit(False)).alias(f"_{i}") for i, (_, m) in enumerate(hits)]).first()
    return [name for name in PRESETS if any(row[f"_{i}"] for i, (n, _) in enumerate(hits) if n == name)]
