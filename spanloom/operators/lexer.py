"""A lexer for languages with braces: what is code and what is a comment or a
string, in one pass and linear time."""

from __future__ import annotations

import re

#: What ends plain code, by language: comments, strings, and braces where a
#: template string may hold code.
_STARTS = {
    "rust": re.compile(r"//|/\*|\b(?:br|cr|r)#*\"|b?\"|c\"|b?'(?:\\.[^']*|[^\\'])'"),
    "go": re.compile(r"//|/\*|\"|`|'(?:\\.[^'\n]*|[^\\'\n])'"),
    "javascript": re.compile(r"//|/\*|[\"'`{}]|/"),
}
FAMILY = {"rust": "rust", "go": "go", **dict.fromkeys(("javascript", "typescript", "jsx", "tsx"), "javascript")}
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_STRING = {q: re.compile(rf"(?:\\.|[^\\{q}])*{q}", re.S) for q in "\"'"}
_LINE_STRING = {q: re.compile(rf"(?:\\.|[^\\{q}\n])*{q}", re.S) for q in "\"'"}
_PATTERN = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: What stands before a pattern and not before a division.
_BEFORE_PATTERN = re.compile(r"(?:^|[(\[{}=,:;!&|?+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))\s*$")
_BLANKED = re.compile(r"[^\n]")


class Unfinished(ValueError):
    """A string or comment that the text does not end."""


def _after(pattern: re.Pattern, text: str, at: int) -> int:
    found = pattern.match(text, at)
    if not found:
        raise Unfinished(at)
    return found.end()


def code_only(text: str, language: str) -> str:
    """``text`` with blanks in place of comments, strings and patterns; lines and
    places stay. Raises Unfinished where one of them has no end."""
    family = FAMILY[language]
    starts, out, at, n = _STARTS[family], [], 0, len(text)
    #: For each template string that code stands in: braces open in that code.
    templates: list[int] = []

    def template(i: int) -> int:
        """From inside a template string to its end, or into its code."""
        while True:
            found = _TEMPLATE.search(text, i)
            if not found:
                raise Unfinished(i)
            if found[0] == "`":
                return found.end()
            if found[0] == "${":
                templates.append(0)
                return found.end()
            i = found.end()

    while at < n:
        found = starts.search(text, at)
        if not found:
            break
        begin, mark, end = found.start(), found[0], found.end()
        out.append(text[at:begin])
        blank = True
        if mark == "//":
            end = text.find("\n", begin)
            end = n if end < 0 else end
        elif mark == "/*":
            depth = 1
            while depth:
                turn = _NESTED.search(text, end)
                if not turn:
                    raise Unfinished(begin)
                end = turn.end()
                if turn[0] == "*/":
                    depth -= 1
                elif family == "rust":
                    depth += 1
        elif family == "rust" and mark.endswith('"') and ("#" in mark or mark[:-1] in ("r", "br", "cr")):
            close = '"' + "#" * mark.count("#")
            end = text.find(close, end)
            if end < 0:
                raise Unfinished(begin)
            end += len(close)
        elif mark.endswith('"') or mark == "'":
            end = _after((_STRING if family == "rust" else _LINE_STRING)[mark[-1]], text, end)
        elif mark == "`":
            if family == "go":
                end = text.find("`", end) + 1
                if not end:
                    raise Unfinished(begin)
            else:
                end = template(end)
        elif mark == "{":
            blank = False
            if templates:
                templates[-1] += 1
        elif mark == "}":
            blank = False
            if templates and not templates[-1]:
                templates.pop()
                end, blank = template(end), True
            elif templates:
                templates[-1] -= 1
        elif mark == "/":
            before = text[max(0, begin - 80) : begin].rpartition("\n")[2]
            pattern = _PATTERN.match(text, begin) if _BEFORE_PATTERN.search(before) else None
            blank, end = bool(pattern), pattern.end() if pattern else end
        out.append(_BLANKED.sub(" ", text[begin:end]) if blank else text[begin:end])
        at = end
    if templates:
        raise Unfinished(n)
    out.append(text[at:])
    return "".join(out)
