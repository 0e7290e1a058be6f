"""The language dimension: extensions, separators, call-proving usages, limits of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages with their extensions; separators other than the dot; usages that prove calls; limits of the extraction.
EXTENSIONS = """
ada .adb .ads .ada
angular_template
assembly .asm .s
astro .astro
awk .awk
bash .sh .bash .bats
c .c .h
clojure .clj .cljs .cljc .bb
cobol .cob .cbl .cobol .cpy
common_lisp .lisp .lsp .cl .asd
cpp .cpp .cc .cxx .hpp .hh .hxx
crystal .cr
csharp .cs
cuda .cu .cuh .cuda
d .d .di
dart .dart
elixir .ex .exs
elm .elm
emacs_lisp .el
erlang .erl .hrl
fish .fish
fsharp .fs .fsi .fsx
gdscript .gd
fortran .f .for .f90 .f95 .f03 .f08
glsl .glsl .vert .frag .geom .tesc .tese .comp
gleam .gleam
go .go
groovy .groovy .gradle .gvy .gy
haxe .hx
haskell .hs .lhs
hlsl .hlsl .fx .fxh
java .java
javascript .js .jsx .mjs .cjs
julia .jl
kotlin .kt .kts
less .less
lua .lua
luau .luau
matlab .m
nim .nim .nims
nushell .nu
objc .mm
ocaml .ml .mli
perl .pl .pm .t
pascal .pas .pp
php .php
powershell .ps1 .psm1 .psd1
purescript .purs
python .py
r .r
rescript .res .resi
ruby .rb
rust .rs
scala .scala .sc
scss .scss
smalltalk .st
sql .sql
svelte .svelte
swift .swift
typescript .ts .mts .cts
verilog .v .vh .verilog
vhdl .vhd .vhdl
vimscript .vim
tsx .tsx
vue .vue
wgsl .wgsl
zig .zig
zsh .zsh
"""
SUFFIXES = {".component.html": "angular_template"}
SEPARATORS = {"cpp": "::", "crystal": "::", "cuda": "::", "perl": "::", "ruby": "::", "rust": "::", "php": "\\"}
CALLS = {
    "csharp": ("invocation", "object-creation"),
    "javascript": ("invocation", "object-creation"),
    "python": ("invocation",),
    "typescript": ("invocation", "object-creation"),
    "tsx": ("invocation", "object-creation"),
}
USAGES = {
    "csharp": (
        "member-access", "invocation", "nameof", "object-creation", "generic-type", "type-argument", "declared-type", "return-type", "type-literal", "cast-and-pattern", "attribute", "base-type",
    ),
    "javascript": ("invocation", "object-creation"),
    "python": ("invocation", "base-type", "decorator"),
    "typescript": ("invocation", "object-creation"),
    "tsx": ("invocation", "object-creation"),
}
_SCRIPT_LIMITS = ("dynamic-dispatch", "member-call-receiver-types", "import-alias-relations", "local-variables", "configuration-strings", "non-call-references")
LIMITS = {
    "csharp": ("static-receiver-types", "extension-methods", "inherited-members", "partial-classes"),
    "javascript": _SCRIPT_LIMITS,
    "python": ("inherited-members", "union-return-types", "cross-file-factory-returns", "dynamic-receivers", "import-scope-narrowing", "unindexed-import-shadows"),
    "typescript": _SCRIPT_LIMITS,
    "tsx": _SCRIPT_LIMITS,
}
COMPLETENESS = "partial"


def extension_map(table: str = EXTENSIONS) -> dict[str, str]:
    """extension -> language; an extension that two languages claim is an error."""
    found: dict[str, str] = {}
    for language, *extensions in (line.split() for line in table.strip().splitlines()):
        for e in extensions:
            if e in found:
                raise ValueError(f"{e} is claimed by {found[e]} and {language}")
            found[e] = language
    return found


BY_EXTENSION = extension_map()
LANGUAGES = tuple(line.split()[0] for line in EXTENSIONS.strip().splitlines())


def detect(name: str) -> str | None:
    """The language of a file name: compound suffixes first, then the last extension in lower case."""
    low = name.rsplit("/", 1)[-1].lower()
    for suffix, language in SUFFIXES.items():
        if low.endswith(suffix) and len(low) > len(suffix):
            return language
    stem, dot, extension = low.rpartition(".")
    return BY_EXTENSION.get(dot + extension) if stem.lstrip(".") else None


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """A map of a fixed size as an expression; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def language_of(path) -> Column:
    """`detect` as an expression; null for unknown extensions."""
    c = F.col(path) if isinstance(path, str) else path
    low = F.lower(F.substring_index(c, "/", -1))
    out = F
    for suffix, language in SUFFIXES.items():
        out = out.when(low.endswith(suffix) & (F.length(low) > len(suffix)), language)
    # A leading dot names a file, not an extension.
    return out.otherwise(_lookup(BY_EXTENSION, F.regexp_extract(low, r"[^.].*(\.[^.]+)$", 1)))


def separator_of(language) -> Column:
    c = F.col(language) if isinstance(language, str) else language
    return F.coalesce(_lookup(SEPARATORS, c), F.lit("."))


def proves_call(language, usage_kind) -> Column:
    """Whether a usage kind proves a call in a language; null and unknown ones prove nothing."""
    lang = F.col(language) if isinstance(language, str) else language
    use = F.col(usage_kind) if isinstance(usage_kind, str) else usage_kind
    found = F.lit(False)
    for name, kinds in CALLS.items():
        found = found | ((lang == name) & use.isin(*kinds))
    return F.coalesce(found, F.lit(False))


def dimension(spark: SparkSession) -> DataFrame:
    """language, extensions, separator, call_kinds, usage_kinds, limitations, completeness of every language."""
    rows = []
    for language, *extensions in (line.split() for line in EXTENSIONS.strip().splitlines()):
        rows.append((language, extensions, SEPARATORS.get(language, "."), list(CALLS.get(language, ())), list(USAGES.get(language, ())), list(LIMITS.get(language, ())), COMPLETENESS))
    return spark.createDataFrame(rows, "language string, extensions array<string>, separator string, call_kinds array<string>, usage_kinds array<string>, limitations array<string>, completeness string")


def calibration(languages: list[str], evidence: set[str] | None = None) -> list[dict]:
    """What the extraction of languages covers, for payloads; languages without evidence say so."""
    out = []
    for language in languages:
        entry = {"language": language, "completeness": COMPLETENESS, "call_kinds": list(CALLS.get(language, ())), "limitations": list(LIMITS.get(language, ()))}
        if evidence is not None and language not in evidence:
            entry["evidence"] = False
        out.append(entry)
    return out
