"""Facts about source code: definitions, imports and calls, read per file."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "file_path string, kind string, name string, owner string, line int"
_JS_IMPORT = re.compile(r"^\s*import\s+(?:.*?\s+from\s+)?['\"]([^'\"]+)['\"]")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$]*)\s*\(")
_PY_DEF = re.compile(r"^\s*(?:async\s+)?def\s+(\w+)|^\s*class\s+(\w+)")
_NO_CALL = {"if", "for", "while", "switch", "return", "function", "catch", "def", "class", "print", "elif", "with", "and", "or", "not", "in"}


def python_facts(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, owner, line) from the syntax tree; line by line where it doesn't parse."""
    try:
        tree = ast.parse(text.replace("\r\n", "\n").replace("\r", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("function" if m[1] else "class", m[1] or m[2], "", i) for i, line in enumerate(text.splitlines(), 1) if (m := _PY_DEF.match(line))]
    out = []

    def walk(node, owner, in_class):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{n.name}" if in_class else n.name
                out.append(("method" if in_class else "function", name, owner, n.lineno))
                walk(n, name, False)
            elif isinstance(n, ast.ClassDef):
                out.append(("class", n.name, owner, n.lineno))
                walk(n, n.name, True)
            else:
                if isinstance(n, ast.Import):
                    out.extend(("import", a.name, owner, n.lineno) for a in n.names)
                elif isinstance(n, ast.ImportFrom):
                    out.append(("import", "." * n.level + (n.module or ""), owner, n.lineno))
                elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                    out.append(("call", n.func.id if isinstance(n.func, ast.Name) else n.func.attr, owner, n.lineno))
                walk(n, owner, in_class)

    walk(tree, "", False)
    return out


def script_facts(text: str) -> list[tuple[str, str, str, int]]:
    """Imports and calls of JavaScript and TypeScript, line by line."""
    out = []
    for i, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        if m := _JS_IMPORT.match(line):
            out.append(("import", m[1], "", i))
        elif not re.match(r"^\s*(?://|\*|/\*)", line) and not re.search(r"\bfunction\b|=>|\{\s*$", line):
            out += [("call", c, "", i) for c in _CALL.findall(line) if c not in _NO_CALL]
    return out


def facts(raw: DataFrame, text_col: str = "content", files_col: str = "files_mentioned") -> DataFrame:
    """(file_path, kind, name, owner, line) of Python, JavaScript and TypeScript files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b.file_path, b.content):
                rows += [(p, *f) for f in (python_facts(t) if p.endswith(".py") else script_facts(t))]
            yield pd.DataFrame(rows, columns=["file_path", "kind", "name", "owner", "line"]).astype({"line": "int32"})

    f = raw.select(F.explode(files_col).alias("file_path"), F.col(text_col).alias("content")).where(F.col("file_path").rlike(r"\.(?:py|js|jsx|ts|tsx)$") & F.col("content").isNotNull())
    return f.mapInPandas(run, FACT)


SMELL = "file_path string, rule string, severity string, line int"
# fixed values: the severity of each rule
SEVERITY = {"bare_except": "P0", "broad_catch": "P1", "swallowed_error": "P0", "empty_function": "P2"}


def python_smells(text: str) -> list[tuple[str, str, int]]:
    """(rule, severity, line) of one Python text, from its syntax tree; none where it doesn't parse.

    bare_except: ``except:``. broad_catch: ``except Exception`` or ``BaseException``.
    swallowed_error: a handler of nothing but pass and return. empty_function: a body of
    nothing but pass and ``...``, a docstring aside.
    """
    try:
        tree = ast.parse(text.replace("\r\n", "\n").replace("\r", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    blank = lambda b: isinstance(b, ast.Pass) or isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and (b.value.value is ... or isinstance(b.value.value, str))
    for n in ast.walk(tree):
        if isinstance(n, ast.ExceptHandler):
            if n.type is None:
                out.append(("bare_except", n.lineno))
            elif isinstance(n.type, ast.Name) and n.type.id in ("Exception", "BaseException"):
                out.append(("broad_catch", n.lineno))
            if all(isinstance(b, (ast.Pass, ast.Return)) for b in n.body):
                out.append(("swallowed_error", n.lineno))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and all(map(blank, n.body)):
            out.append(("empty_function", n.lineno))
    return [(rule, SEVERITY[rule], line) for rule, line in sorted(out, key=lambda x: (x[1], x[0]))]


def smells(raw: DataFrame, text_col: str = "content", files_col: str = "files_mentioned") -> DataFrame:
    """(file_path, rule, severity, line) of every Python file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, t in zip(b.file_path, b.content) for x in python_smells(t)]
            yield pd.DataFrame(rows, columns=["file_path", "rule", "severity", "line"]).astype({"line": "int32"})

    f = raw.select(F.explode(files_col).alias("file_path"), F.col(text_col).alias("content")).where(F.col("file_path").endswith(".py") & F.col("content").isNotNull())
    return f.mapInPandas(run, SMELL)


def references(facts: DataFrame, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, kind, name, target): imports that name a file, by any of its module names, and calls that name a symbol.

    ``names``: (module, file_path); ``symbols``: (name, file_path). Two equi-joins.
    """
    f = facts.select(F.col("file_path").alias("source"), "kind", "name").distinct()
    n = names.select(F.lit("import").alias("kind"), F.col("module").alias("name"), F.col("file_path").alias("target"))
    n = n.unionByName(symbols.select(F.lit("call").alias("kind"), "name", F.col("file_path").alias("target")))
    return f.join(n.distinct(), ["kind", "name"]).select("source", "kind", "name", "target")


def impacted(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): symbols whose lines hold a changed line, once each. ``symbols``: (id, file_path, line_start, line_end); ``changed``: (file_path, line).

    A point in an interval as an equi-join on file and block of 64 lines.
    """
    block = lambda c: F.floor(F.col(c) / 64)
    s = symbols.where("line_start is not null and line_end >= line_start").select("id", "file_path", "line_start", "line_end", F.explode(F.sequence(block("line_start"), block("line_end"))).alias("b"))
    c = changed.select("file_path", "line").distinct().withColumn("b", block("line"))
    return s.join(c, ["file_path", "b"]).where("line between line_start and line_end").select("id").distinct()
