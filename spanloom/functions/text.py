"""Column functions over texts, queries and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "go": "go",
    "java": "java", "kt": "kotlin", "rb": "ruby", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "cpp",
    "hpp": "cpp", "cs": "csharp", "swift": "swift", "scala": "scala", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "json": "json", "md": "markdown", "html": "html", "css": "css", "sh": "bash", "bash": "bash", "sql": "sql",
}
#: Directories that a scan never enters; the last is this engine's own index.
IGNORED_DIRS = (".git", "target", "node_modules", "dist", ".spanloom")


def _without_last(text: Column, end: str) -> Column:
    return F.when(text.endswith(end), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def lines(text: Column) -> Column:
    """Lines of a text: one final line feed is dropped, then one carriage return
    of each line; an empty text has none."""
    parts = F.transform(F.split(_without_last(text, "\n"), "\n", -1), lambda x: _without_last(x, "\r"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


#: A word of ``words``, in lower-cased text.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats included."""
    return F.filter(words_and_gaps(text), lambda w: w != "")


def words_and_gaps(text: Column) -> Column:
    """The words of a text, with an empty one at an end that is no word."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def query_tokens(query: Column) -> Column:
    """Distinct search tokens: cut at blanks and : / " ( ), lower-cased, two or
    more bytes, not starting with an underscore."""
    parts = F.split(F.lower(query), r"[\s:/\"()]+", -1)
    return F.array_distinct(F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.startswith("_")))


def language_of(path: Column) -> Column:
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for language in dict.fromkeys(LANGUAGES.values()):
        ends = [e for e, v in LANGUAGES.items() if v == language]
        out = F.when(extension.isin(ends), language).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def is_safe_path(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS)))


def glob_matches(path: Column, pattern: str) -> Column:
    """The restricted globs of a scan policy: everything, ``dir/**``, an
    extension at any depth, ``*.ext``, ``.env*``, or an exact path. A pattern
    that holds ``/**`` counts as the directory left without its last three
    characters."""
    name = F.element_at(F.split(path, "/"), -1)
    if pattern in ("**", "**/*"):
        return F.lit(True)
    out = path == pattern
    if "/**" in pattern:
        folder = pattern[:-3]
        out = out | (path == folder) | path.startswith(folder + "/")
    if pattern.startswith("/**"):
        out = F.lit(True)
    if pattern.startswith("**/*."):
        out = out | path.endswith(pattern[4:])
    if pattern.startswith("*."):
        out = out | name.endswith(pattern[1:])
    if pattern.startswith(".env*"):
        out = out | name.startswith(".env")
    return out


def admitted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a scan takes a path; an empty include list takes all."""
    keep = ~is_ignored(path)
    for pattern in exclude:
        keep = keep & ~glob_matches(path, pattern)
    if include:
        wanted = F.lit(False)
        for pattern in include:
            wanted = wanted | glob_matches(path, pattern)
        keep = keep & wanted
    return keep


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8192 bytes."""
    return F.hex(F.substring(content, 1, 8192)).rlike("^(..)*00")


def normalized_path(path: Column) -> Column:
    """Folds ``.`` and ``..`` components."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(
            F.concat(a, F.array(p))
        ),
    )
    return F.array_join(kept, "/")


def parse_path_spec(spec: str) -> tuple[str, int | None, int | None]:
    """``path``, ``path:N`` or ``path:N-M`` (1-based)."""
    found = re.fullmatch(r"(.*):(\d+)(?:-(\d+))?", spec)
    if not found:
        return spec, None, None
    start, end = int(found[2]), int(found[3] or found[2])
    if start < 1 or start > end:
        raise ValueError(f"bad line range in {spec!r}")
    return found[1], start, end


def split_identifier(name: Column) -> Column:
    """Lower-cased parts of a snake or camel name of three or more bytes."""
    spaced = F.regexp_replace(name, r"(\p{Lu})", " $1")
    return F.filter(F.transform(F.split(spaced, r"[\s_]+", -1), F.lower), lambda p: F.octet_length(p) >= 3)


def normalized_query(query: Column) -> Column:
    """Camel and snake names split, lower-cased; words of three or more
    characters, the first twelve; the query itself if none is left."""
    spaced = F.regexp_replace(F.regexp_replace(query, r"([a-z0-9])([A-Z])", "$1 $2"), "_", " ")
    kept = F.slice(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+", -1), lambda w: F.length(w) >= 3), 1, 12)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def view_id(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), F.lit(16))


def cache_key(*parts: Column) -> Column:
    return F.concat(F.lit("emb1:"), F.sha2(F.concat_ws(":", *parts).cast("binary"), 256))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def sanitized_query(query: Column) -> Column:
    """A query that no query syntax can reject: its operators as blanks."""
    return F.trim(F.translate(query, ":/()\"", "     "))


#: Words of programming languages that name nothing.
KEYWORDS = (
    "fn", "let", "mut", "pub", "use", "mod", "impl", "struct", "enum", "trait", "if", "else", "for", "while", "return", "self",
    "Self", "super", "crate", "true", "false", "def", "class", "import", "from", "async", "await", "const", "var", "function",
    "type", "interface",
)


def is_keyword(name: Column) -> Column:
    return name.isin(*KEYWORDS)


def is_string_assignment(line: Column) -> Column:
    """Whether a line gives a name a quoted value."""
    return line.contains('="') | line.contains("= '") | line.contains('= "')
