"""Source files to symbols and raw references, read through Spark and parsed by the standard library in batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOL = "struct<id:string,kind:string,name:string,qualified_name:string,container_id:string,start_line:int,end_line:int,signature:string>"
REF = "struct<ref_id:string,from_symbol_id:string,start_line:int,to_name:string,qualified_text:string,scope_prefix:string,usage_kind:string>"
SCHEMA = f"path string, content_hash string, language string, problem string, symbols array<{SYMBOL}>, refs array<{REF}>"


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path below the root, content, content_hash of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^[a-z]+:/+", "/")
    bare = F.lit("/" + root.split("://")[-1].strip("/") + "/")
    return files.select(F.substring(path, F.length(bare) + 1, F.length(path)).alias("path"), "content", F.sha2("content", 256).alias("content_hash"))


class _Visitor(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.lines = path, text.splitlines()
        parts = path.removesuffix(".py").split("/")
        self.module = ".".join(parts[:-1] if parts[-1] == "__init__" else parts)
        self.symbols, self.refs, self.inside, self.seen = [], [], [], {}

    def add(self, kind: str, name: str, node: ast.AST) -> str:
        qualified = ".".join([self.module, *[n for _, n, _ in self.inside], name])
        symbol = f"{self.path}:{kind}:{qualified}:{node.lineno}"
        up = self.inside[-1][0] if self.inside else None
        signature = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
        self.symbols.append({"id": symbol, "kind": kind, "name": name, "qualified_name": qualified, "container_id": up, "start_line": node.lineno, "end_line": getattr(node, "end_lineno", node.lineno), "signature": signature or None})
        return symbol

    def use(self, kind: str, name: str, node: ast.AST, qualified: str | None = None) -> None:
        inside = self.inside[-1][0] if self.inside else None
        at = f"{self.path}:{node.lineno}:{node.col_offset}:{name}"
        if at not in self.seen:
            self.seen[at] = True
            self.refs.append({"ref_id": at, "from_symbol_id": inside, "start_line": node.lineno, "to_name": name, "qualified_text": qualified, "scope_prefix": self.module, "usage_kind": kind})

    def within(self, symbol: str, name: str, kind: str, body: list) -> None:
        self.inside.append((symbol, name, kind))
        for child in body:
            self.visit(child)
        self.inside.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        symbol = self.add("class", node.name, node)
        for base in node.bases:
            self.named("base-type", base)
        for d in node.decorator_list:
            self.named("decorator", d)
        self.within(symbol, node.name, "class", node.body)

    def visit_FunctionDef(self, node) -> None:
        kind = "method" if self.inside and self.inside[-1][2] == "class" else "function"
        symbol = self.add(kind, node.name, node)
        for d in node.decorator_list:
            self.named("decorator", d)
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            if a.annotation:
                self.named("declared-type", a.annotation)
        if node.returns:
            self.named("return-type", node.returns)
        self.within(symbol, node.name, kind, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and (not self.inside or self.inside[-1][2] == "class"):
                self.add("constant" if t.id.isupper() else "field" if self.inside else "variable", t.id, node)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        self.named("invocation", node.func)
        for child in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(child)
        if isinstance(node.func, ast.Attribute):
            self.visit(node.func.value)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.named("member-access", node)
        self.visit(node.value)

    def named(self, kind: str, node: ast.AST) -> None:
        if isinstance(node, ast.Name):
            self.use(kind, node.id, node)
        elif isinstance(node, ast.Attribute):
            parts, at = [node.attr], node.value
            while isinstance(at, ast.Attribute):
                parts.append(at.attr)
                at = at.value
            whole = ".".join(reversed([*parts, at.id])) if isinstance(at, ast.Name) else None
            self.use(kind, node.attr, node, whole)
        elif isinstance(node, (ast.Call, ast.Subscript)):
            self.named(kind, node.func if isinstance(node, ast.Call) else node.value)


def parse(files: DataFrame) -> DataFrame:
    """One row a file with its symbols and references; a file that can't be parsed has none and a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, digest in zip(pdf["path"], pdf["content"], pdf["content_hash"], strict=True):
                text, problem = bytes(content).decode("utf-8", "replace"), None
                v = _Visitor(path, text)
                try:
                    v.visit(ast.parse(text))
                except (SyntaxError, ValueError, RecursionError) as e:
                    v, problem = _Visitor(path, text), type(e).__name__
                rows.append((path, digest, "python", problem, v.symbols, v.refs))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "language", "problem", "symbols", "refs"])

    return files.select("path", "content", "content_hash").mapInPandas(run, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), "language", F.explode("symbols").alias("s")).select("s.*", "file_path", "language")


def raw_refs(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("from_file_path"), F.explode("refs").alias("r")).select("r.*", "from_file_path")
