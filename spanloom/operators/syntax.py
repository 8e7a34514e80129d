"""Syntax chunks and symbols. Python is parsed with its own grammar; in brace
languages strings and comments are lexed out, and definitions end with the
brace that they open. Each file is parsed alone, inside one row, in linear time."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .lexer import FAMILY, Unfinished, code_only

CHUNK_LINES = 30
HEADER_LINES = 10
_BLOCK = re.compile(
    r"^[ \t]*(?:pub(?:\([^)\n]*\))?\s+|export\s+|default\s+|declare\s+|async\s+|abstract\s+|unsafe\s+|const\s+(?=fn\b|enum\b))*"
    r"(?:impl(?:<[^>\n]*>)?\s+(?:[^{;\n]*\sfor\s+)?(?P<impl>[A-Za-z_]\w*)"
    r"|macro_rules!\s*(?P<macro>[A-Za-z_]\w*)"
    r"|(?P<word>fn|struct|enum|trait|mod|function\*?|class|interface|func|type|const|let|var|static)\s+(?:mut\s+)?(?:\([^)\n]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*))",
    re.M,
)
#: Methods of classes; words that open blocks of other kinds don't name one.
_METHOD = re.compile(r"^[ \t]*(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+|\*\s*)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\(", re.M)
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "super", "await", "new", "throw", "typeof"}
#: Words that define something in each family of languages; others are local.
_WORDS = {
    "rust": {"fn", "struct", "enum", "trait", "mod", "type"},
    "javascript": {"function", "function*", "class", "interface", "type", "const", "let", "var", "enum"},
    "go": {"func", "type", "const", "var"},
}
_KINDS = {"fn": "function", "func": "function", "function*": "function", "mod": "module", "let": "const", "var": "const"}
_STRUCTURE = re.compile(r"[{}()\[\];\n]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def python_definitions(text: str) -> list[tuple[int, int, str, str, int]] | None:
    """(start, end, kind, name, depth) of functions and classes; None if the text
    is no Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []

    def walk(node: ast.AST, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                out.append((start, child.end_lineno, kind, child.name, depth))
                walk(child, depth + 1)
            else:
                walk(child, depth)

    walk(tree, 0)
    return out


def _headers(code: str, family: str) -> list[tuple[int, str, str]]:
    """(place, kind, name) of what may begin a definition, in order."""
    out = []
    for found in _BLOCK.finditer(code):
        word = "impl" if found["impl"] else "macro" if found["macro"] else found["word"]
        if word in _WORDS[family] or (word in ("impl", "macro") and family == "rust"):
            name = found["impl"] or found["macro"] or found["name"]
            out.append((found.end() - len(name), _KINDS.get(word, word), name))
    if family == "javascript":
        known = {at for at, _, _ in out}
        out += [(m.start("name"), "method", m["name"]) for m in _METHOD.finditer(code) if m["name"] not in _NO_METHOD and m.start("name") not in known]
    return sorted(out)


def brace_definitions(text: str, language: str = "typescript") -> list[tuple[int, int, str, str, int]] | None:
    """The same for languages with braces: a definition ends with the brace that
    closes the one it opens; without one at its semicolon, or (outside Rust) at
    the last line before the next definition or the end of its block. None if a
    string or comment doesn't end or brackets don't pair."""
    family = FAMILY[language]
    try:
        code = code_only(text, language)
    except Unfinished:
        return None
    headers, out = _headers(code, family), []
    breaks = [m.start() for m in re.finditer("\n", code)]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    #: Open brackets: (bracket, the definitions that it ends, kind of the innermost definition).
    stack: list[tuple[str, list, str]] = []
    pending: list[tuple[int, str, str, int]] = []
    last_code, previous, following, braces = 0, 0, 0, 0

    def finish(which: list, end: int) -> None:
        for at, kind, name, depth in which:
            out.append((line_of(at), max(line_of(end), line_of(at)), kind, name, depth))

    for mark in _STRUCTURE.finditer(code):
        here, sign = mark.start(), mark[0]
        between = code[previous:here].rstrip()
        while following < len(headers) and headers[following][0] < here:
            at, kind, name = headers[following]
            following += 1
            inner = stack[-1] if stack else ("{", [], "")
            # Names of a function's own values define nothing outside it.
            if inner[0] != "{" or (kind == "method" and inner[2] != "class") or (kind == "const" and braces):
                continue
            if pending:
                finish(pending, last_code)
                pending = []
            pending = [(at, kind, name, braces)]
        if between.strip():
            last_code = previous + len(between) - 1
        flat = not stack or stack[-1][0] == "{"
        if sign in "([":
            stack.append((sign, [], stack[-1][2] if stack else ""))
        elif sign == "{":
            braces += 1
            held, pending = (pending, []) if flat else ([], pending)
            stack.append((sign, held, held[-1][1] if held else stack[-1][2] if stack and not flat else ""))
        elif sign in ")]}":
            if not stack or stack[-1][0] != _PAIR[sign]:
                return None
            _, held, _ = stack.pop()
            if sign == "}":
                braces -= 1
                if pending and (not stack or stack[-1][0] == "{"):
                    finish(pending, last_code)
                    pending = []
                finish(held, here)
        elif sign == ";" and flat and pending:
            finish(pending, here)
            pending = []
        elif sign == "\n" and flat and pending and family == "go" and between[-1:] not in tuple(",(+-*/|&=<>.") and between.strip():
            finish(pending, last_code)
            pending = []
        if sign not in "\n":
            last_code = here
        previous = mark.end()
    if stack:
        return None
    while following < len(headers):
        at, kind, name = headers[following]
        following += 1
        if kind != "method":
            finish(pending, last_code)
            pending = [(at, kind, name, 0)]
    tail = code[previous:].rstrip()
    finish(pending, previous + len(tail) - 1 if tail else last_code)
    return sorted(out)


def definitions(text: str, language: str) -> list[tuple[int, int, str, str, int]]:
    if language == "python":
        return python_definitions(text) or []
    if language in FAMILY:
        return brace_definitions(text, language) or []
    return []


def line_count(text: str) -> int:
    return len(text.removesuffix("\n").split("\n")) if text else 0


def syntax_chunks(text: str, language: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, name): outermost definitions, cut at CHUNK_LINES, and
    the gaps between them; the chunks cover every line once."""
    total, out, at = line_count(text), [], 1

    def add(start: int, end: int, kind: str, name: str | None) -> None:
        for s in range(start, end + 1, CHUNK_LINES):
            out.append((s, min(end, s + CHUNK_LINES - 1), kind, name))

    for start, end, kind, name, _ in sorted(definitions(text, language)):
        end = min(end, total)
        if start < at or start > end:
            continue
        if start > at:
            add(at, start - 1, "gap", None)
        add(start, end, kind, name)
        at = end + 1
    if at <= total:
        add(at, total, "gap" if out else "line_window", None)
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """path, start_line, end_line, kind, symbol_name of each syntax chunk."""
    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *c) for p, lang, t in zip(part["path"], part["language"], part["content"]) for c in syntax_chunks(t or "", lang)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "kind", "symbol_name"])

    return files.select("path", "language", "content").mapInPandas(task, "path string, start_line long, end_line long, kind string, symbol_name string")


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, start_line, end_line (at most ten lines), block_end."""
    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (p, name, kind, start, min(end, start + HEADER_LINES - 1), end)
                for p, lang, t in zip(part["path"], part["language"], part["content"])
                for start, end, kind, name, _ in definitions(t or "", lang)
            ]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line", "block_end"])

    return files.select("path", "language", "content").mapInPandas(
        task, "path string, name string, kind string, start_line long, end_line long, block_end long"
    )
