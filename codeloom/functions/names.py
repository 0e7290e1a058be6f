"""Scalar expressions over names, paths, kinds and evidence; all stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by rank, directories and markers of test and generated code, resolution and confidence ranks, usage kinds by priority.
KINDS = ("class", "record", "interface", "struct", "enum", "type", "function", "method")
TEST_DIRS = ("test", "tests", "testing", "__tests__", "spec", "specs")
GENERATED_DIRS = ("migrations", "migration", "generated", "snapshots", "__snapshots__")
GENERATED_MARKS = (".designer.", ".g.", ".generated.", ".min.")
RESOLUTION_RANKS = {"exact": 0, "scoped": 1, "unique-name": 2, "ambiguous": 4, "unresolved": 5}
CONFIDENCE_RANKS = {"high": 0, "medium": 1, "low": 2}
USAGE_KINDS = ("nameof", "object-creation", "base-type", "decorator", "attribute", "type-literal", "cast-and-pattern", "return-type", "declared-type", "type-argument", "generic-type", "invocation", "member-access")
STEM_SUFFIXES = ("Handler", "Endpoint", "Service", "Repository", "Command", "Query")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def tokens(c) -> Column:
    """Runs of letters and digits, lower-case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def phrase_hit(c, query: str) -> Column:
    """Whether a text's tokens hold the query's as a phrase whose last token may be a prefix; a query without tokens hits nothing."""
    import re

    wanted = re.findall(r"[^\W_]+", query.lower())
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.concat(F.lit(" "), F.array_join(tokens(c), " ")).contains(" " + " ".join(wanted)), F.lit(False))


def in_scope(path, scope: str | None) -> Column:
    """A path is the scope itself or lies below it; letters A to Z of what lies below are compared without case."""
    if not scope:
        return F.lit(True)
    return (_col(path) == scope) | fold(path).startswith(fold_text(scope) + "/")


def path_shaped(term: str) -> bool:
    return "/" in term or "." in term


def path_matches(path, term: str) -> Column:
    folded = fold_text(term)
    found = (_col(path) == term) | fold(path).endswith("/" + folded)
    return found | fold(path).contains(folded) if path_shaped(term) else found


def _dirs_hold(path, names: tuple[str, ...]) -> Column:
    parts = F.split(F.replace(F.lower(_col(path)), F.lit("\\"), F.lit("/")), "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pieces = F.split(F.array_join(dirs, "."), r"\.")
    return F.arrays_overlap(pieces, F.array(*[F.lit(n) for n in names]))


def _file(path) -> Column:
    return F.element_at(F.split(F.replace(F.lower(_col(path)), F.lit("\\"), F.lit("/")), "/"), -1)


def is_test_path(path) -> Column:
    file, stem = _file(path), F.substring_index(_file(path), ".", 1)
    return _dirs_hold(path, TEST_DIRS) | stem.startswith("test_") | stem.endswith("_test") | stem.endswith("_tests") | file.contains(".spec.") | file.contains(".test.")


def is_generated_path(path) -> Column:
    out = _dirs_hold(path, GENERATED_DIRS)
    for m in GENERATED_MARKS:
        out = out | _file(path).contains(m)
    return out


def is_demoted(path) -> Column:
    return is_test_path(path) | is_generated_path(path)


def ranked(c, names) -> Column:
    """The place of a value in a list, the list's length for others and null."""
    out = F
    for i, n in enumerate(names):
        out = out.when(_col(c) == n, i)
    return out.otherwise(len(names))


def kind_rank(kind) -> Column:
    return ranked(kind, KINDS)


def effective_kind_rank(kind, signature) -> Column:
    """A variable or constant with a signature ranks as a function."""
    return F.when(_col(kind).isin("variable", "constant") & _col(signature).isNotNull(), KINDS.index("function")).otherwise(kind_rank(kind))


def resolution_rank(c) -> Column:
    out = F.when(_col(c).isNull(), 3)
    for k, v in RESOLUTION_RANKS.items():
        out = out.when(_col(c) == k, v)
    return out.otherwise(3)


def confidence_rank(c) -> Column:
    return ranked(c, tuple(CONFIDENCE_RANKS))


def edge_trust(kind, resolution) -> Column:
    return F.when(_col(kind) == "contains", "exact").when(_col(resolution).isin("exact", "scoped"), _col(resolution)).otherwise("heuristic")


def usage_rank(c) -> Column:
    return ranked(c, USAGE_KINDS)


def prefix_at_word_start(name, prefix: str) -> Column:
    """The name starts with a lower-case prefix, has it after an underscore, or has its capitalised form after a lower-case letter."""
    import re

    camel = prefix[:1].upper() + prefix[1:]
    return F.lower(_col(name)).startswith(prefix) | F.lower(_col(name)).contains("_" + prefix) | _col(name).rlike(r"\p{Ll}" + re.escape(camel))


def subtoken_match(name, term: str) -> Column:
    """One of the name's words, split at underscores, digits and humps with acronyms whole, equals a lower-case term."""
    words = F.regexp_extract_all(_col(name), F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))
    return F.exists(words, lambda w: F.lower(w) == term)


def path_segments(path) -> Column:
    """Directories and the file's stem; __init__ dropped."""
    parts = F.split(_col(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(stem == "__init__", dirs).otherwise(F.concat(dirs, F.array(stem)))


def import_segments(text) -> Column:
    return F.filter(F.split(F.regexp_replace(_col(text), "::|/", "."), r"\."), lambda x: x != "")


def ends_with(array, other) -> Column:
    """An array ends with another, which isn't empty."""
    return (F.size(other) > 0) & (F.size(array) >= F.size(other)) & (F.slice(array, F.greatest(F.size(array) - F.size(other) + 1, F.lit(1)), F.size(other)) == other)


def name_stem(name) -> Column:
    return F.regexp_replace(_col(name), f"(?<=.)({'|'.join(STEM_SUFFIXES)})$", "")


def estimated_tokens(text) -> Column:
    return F.ceil(F.length(_col(text)) / 4)


def clamped(c, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(c)))


def is_handle(c) -> Column:
    return F.coalesce(_col(c).rlike("^s_[A-Za-z0-9_-]{22}$"), F.lit(False))


def is_continuation(c) -> Column:
    return F.coalesce(_col(c).startswith("c_") & _col(c).contains("@"), F.lit(False))


def crowd_limit(declarations) -> Column:
    return F.greatest(F.lit(25), F.floor(_col(declarations) / 100))
