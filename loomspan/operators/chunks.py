"""Cutting files into chunks and finding their imports.

Python is cut by its syntax tree (by indentation where it is broken), other languages by one pass over their tokens
(``functions.lexer``); files without a definition are one module chunk. Nested definitions are chunks too. A chunk is the exact text of
its definition, modifiers included.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions.text import module_id, stripped

CHUNK = "id string, content string, chunk_type string, file_path string, start_line int, end_line int, language string"
PARSED = ("python", *lexer.FAMILY)


_HEAD = re.compile(r"(?m)^([ \t]*)((?:async[ \t]+)?(?:def|(class))[ \t]+\w+)")
_QUIET = re.compile(r"(?P<q>\"\"\"|''')[\s\S]*?(?:(?P=q)|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|#[^\n]*")


_LINES = re.compile(r"(?<=\n)|(?<=\r)(?!\n)")


def python_definitions(source: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of functions and classes, outer ones first; by indentation where the source is broken."""
    lines = _LINES.split(source)
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line))
    place = lambda row, col: begin[row - 1] + len(lines[row - 1].encode()[:col].decode(errors="ignore"))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(source)
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    try:
        found = [(place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), kinds[type(n)]) for n in ast.walk(tree) if type(n) in kinds]
    except IndexError:  # lines that only one of the two knows
        return _indented(source)
    return sorted(found, key=lambda x: (x[0], -x[1]))


def _indented(source: str) -> list[tuple[int, int, str]]:
    """Definitions of a source that does not parse: a body is the lines that stand further in than its head."""
    # A string's later lines say nothing of indentation.
    quiet = _QUIET.sub(lambda m: "x" * len(m[0].split("\n")[0]) + re.sub(r"[^\n]", " ", m[0][len(m[0].split("\n")[0]) :]), source)
    found: list[tuple[int, int, str]] = []
    waiting: list[tuple[int, int, str]] = []
    at = last = 0
    for line in _LINES.split(quiet):
        body = line.strip()
        if body:
            width = len(line) - len(line.lstrip())
            while waiting and width <= waiting[-1][1] and body[0] not in ")]}":
                start, _, kind = waiting.pop()
                found.append((start, last, kind))
            if m := _HEAD.match(line):
                waiting.append((at + m.start(2), width, "class" if m[3] else "function"))
            last = at + len(line.rstrip())
        at += len(line)
    found += [(start, last, kind) for start, _, kind in waiting]
    return sorted(found, key=lambda x: (x[0], -x[1]))


def definitions(source: str, language: str) -> list[tuple[int, int, str]]:
    if language == "python":
        return python_definitions(source)
    return lexer.definitions(source, language) if language in lexer.FAMILY else []


def cut(source: str, file_path: str, language: str) -> list[tuple]:
    """Rows of CHUNK."""
    out, line, seen = [], 1, 0
    for start, end, kind in definitions(source, language):
        line += source.count("\n", seen, start)
        seen = start
        content = source[start:end]
        last = line + content.count("\n")
        own = hashlib.sha256(f"{file_path}:{line}:{last}:{content[:100]}".encode()).hexdigest()[:16]
        out.append((own, content, kind, file_path, line, last, language))
    if out:
        return out
    return [(hashlib.sha256(f"{file_path}:module".encode()).hexdigest()[:16], source, "module", file_path, 1, len(source.strip().split("\n")), language)]


def module_chunks(files: DataFrame) -> DataFrame:
    """One chunk for each file, by expressions alone."""
    lines = F.size(F.split(stripped(F.col("content")), "\n"))
    return files.select(module_id(F.col("file_path")).alias("id"), "content", F.lit("module").alias("chunk_type"), "file_path", F.lit(1).alias("start_line"), lines.alias("end_line"), "language")


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of (file_path, content, language); only languages with definitions go through Python."""
    parsed = F.coalesce(F.col("language").isin(*PARSED), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for batch in batches:
            rows = [r for p, c, x in zip(batch["file_path"], batch["content"], batch["language"]) for r in cut(c or "", p, x)]
            yield pd.DataFrame(rows, columns=names)

    own = files.where(parsed).select("file_path", "content", "language").mapInPandas(run, CHUNK)
    return own.unionByName(module_chunks(files.where(~parsed)))


_PYTHON_IMPORT = re.compile(r"(?m)^[ \t]*(?:import[ \t]+(?P<names>[\w., \t]+)|from[ \t]+(?P<dots>\.*)(?P<base>[\w.]*)[ \t]+import[ \t]*(?:\((?P<many>[^)]*)|(?P<items>[\w.,* \t]*)))")


def _python_imports(source: str) -> list[str]:
    """Each name of an import, and the module of a from; from dots alone, the names that it takes."""
    found: list[tuple[int, str]] = []
    try:
        for n in ast.walk(ast.parse(source)):
            if isinstance(n, ast.Import):
                found += [(n.lineno, a.name) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                found += [(n.lineno, n.module)] if n.module else [(n.lineno, a.name) for a in n.names]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
        for m in _PYTHON_IMPORT.finditer(quiet):
            names = m["names"] if m["names"] is not None else m["base"] or m["many"] or m["items"] or ""
            found += [(m.start(), x.split()[0].lstrip(".")) for x in names.split(",") if x.split()]
    return [name for _, name in sorted(found, key=lambda x: x[0]) if name != "*"]


def import_names(source: str, language: str) -> list[str]:
    """Packages that a source imports, each once, in order: the first part of a Python, Rust or PHP name, of a path of Go or
    JavaScript (two parts after an @), and the package of a Java name. A statement with several names gives all of them."""
    found: dict[str, None] = {}
    for name in _python_imports(source) if language == "python" else lexer.imports(source, language) if language in lexer.FAMILY else ():
        if language == "python":
            name = name.split(".")[0]
        elif language == "java":
            name = name.rsplit(".", 1)[0]
        elif language == "rust":
            name = name.lstrip(":").split("::")[0]
            name = "" if name in ("crate", "self", "super") else name
        elif language == "php":
            name = name.lstrip("\\").split("\\")[0]
        else:
            name = "/".join(name.split("/")[:2]) if name.startswith("@") else name.split("/")[0]
        if name:
            found[name] = None
    return list(found)


def imports(files: DataFrame) -> DataFrame:
    """(file_path, place, module) of files in languages that are read."""

    @F.pandas_udf("array<string>")
    def run(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([import_names(c or "", x) for c, x in zip(content, language)])

    own = files.where(F.col("language").isin(*PARSED))
    return own.select("file_path", F.posexplode(run("content", "language")).alias("place", "module"))


def capped_content(content: Column, most: int = 5_000) -> Column:
    """What is stored of a long chunk."""
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, most), F.lit("\n...[truncated]")))
