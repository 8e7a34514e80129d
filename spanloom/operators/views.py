"""Embedding views: several short texts that stand for a file, and the ranking
of views and files by the vectors of their texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import ranked

#: The views, in order.
VIEWS = (
    "path_plus_symbol", "signature_only", "signature_plus_doc", "ast_header", "raw_code_trimmed", "comment_docstring",
    "test_name_plus_assert_terms", "config_key_plus_context", "route_plus_handler_signature", "mixed_all_views",
)
MIXED = ("path_plus_symbol", "signature_plus_doc", "comment_docstring", "config_key_plus_context", "route_plus_handler_signature")
#: What a definition looks like in a line of each language.
SYMBOL_LINES = {
    "rust": ((r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "fn"), (r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", "type")),
    "python": ((r"^\s*(?:async\s+def|def)\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class")),
    "go": ((r"^func\s+(?:\([^)]*\)\s+)?(\w+)", "function"), (r"^type\s+(\w+)\s+(?:struct|interface)", "type")),
    "javascript": ((r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"(?:export\s+)?(?:default\s+)?class\s+(\w+)", "class")),
    "typescript": ((r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"), (r"(?:export\s+)?(?:interface|type|class)\s+(\w+)", "type")),
    "java": (
        (r"^\s*(?:public\s+)?(?:class|interface|enum)\s+(\w+)", "type"),
        (r"^\s*(?:public|protected|private)\s+(?:static\s+)?[\w<>\[\], ?]+\s+(\w+)\s*\(", "method"),
    ),
    "ruby": ((r"^\s*(?:class|module)\s+([A-Z]\w*)", "type"), (r"^\s*def\s+(?:self\.)?(\w+[!?=]?)", "method")),
}
#: Lines of comments, tests, routes and settings.
COMMENT = r"^\s*(#|//|/\*|\*|<!--|\"\"\"|''')"
ASSERT = r"(?i)\b(assert|expect|should|pytest|describe\(|it\(|test\()\b"
ROUTE = r"(?i)(@app\.route|router\.|\.get\(|\.post\(|\.put\(|\.delete\(|Route\(|http\.)"
SETTING = r"^\s*([A-Za-z_][\w.-]*)\s*[:=]"
TEST_PATH = r"(?i)(test|spec)"
CONFIG_PATH = r"(?i)\.(toml|yaml|yml|json|ini)$"
#: How many symbols, lines, terms, keys or routes a view takes.
SYMBOLS, RAW_LINES, RAW_CHARS, COMMENT_LINES, COMMENT_CHARS, TERMS, KEYS, ROUTES = 80, 60, 3000, 24, 2400, 30, 80, 24
#: Fixed value: words of a text that is hashed into a vector.
WORD = r"[a-z_][a-z0-9_]*|[a-z]+|\d+"
#: Tasks that one scan of the views scores.
TASK_BLOCK = 4096


def _line_symbols(language: Column) -> Column:
    """Symbols (line, name, order, kind) of ``_lines``; TypeScript has those of
    JavaScript too."""
    families = {k: v for k, v in SYMBOL_LINES.items()} | {"typescript": SYMBOL_LINES["javascript"] + SYMBOL_LINES["typescript"]}

    def of_pattern(line: Column, i: Column, order: int, pattern: str, kind: str) -> Column:
        names = F.regexp_extract_all(line, F.lit("(?U)" + pattern), F.lit(1))
        return F.transform(names, lambda n: F.struct((i + 1).alias("line"), n.alias("name"), F.lit(order).alias("order"), F.lit(kind).alias("kind")))

    def of_line(line: Column, i: Column) -> Column:
        out = None
        for name, patterns in families.items():
            found = F.flatten(F.array(*[of_pattern(line, i, order, p, kind) for order, (p, kind) in enumerate(patterns)]))
            out = F.when(language == name, found) if out is None else out.when(language == name, found)
        return out.otherwise(F.array().cast("array<struct<line:int,name:string,order:int,kind:string>>"))

    return F.slice(F.array_sort(F.flatten(F.transform("_lines", of_line))), 1, SYMBOLS)


def file_views(files: DataFrame) -> DataFrame:
    """repo_id, path, view, ordinal, start_line, end_line, content_sha, language,
    text, data_level of each view of each file (repo_id, path, content_sha,
    language, content); ordinal counts a file's records of one view from 1.

    Definitions are told by their lines, and a view takes the first of them up
    to the fixed counts above. One pass over the files, without a shuffle. A
    null or empty content has no views; null languages have no symbols."""
    c, i32 = F.col, lambda x: x.cast("int")
    base = files.where("content <> ''").select("repo_id", "path", "content_sha", F.coalesce("language", F.lit("")).alias("language"), T.lines(c("content")).alias("_lines"))
    n, path, language, all_lines = F.size("_lines"), c("path"), c("language"), c("_lines")
    trimmed = F.transform(all_lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = lambda pattern: F.filter(F.transform("_trim", lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda s: s.x.rlike(pattern))
    # c: comment, b: blank, x: other; from the last line to the first.
    classes = F.reverse(F.array_join(F.transform("_trim", lambda x: F.when(x == "", "b").when(x.rlike(COMMENT), "c").otherwise("x")), ""))
    told = base.withColumn("_trim", trimmed).withColumns({
        "_symbols": _line_symbols(language), "_classes": classes, "_comments": kept(COMMENT), "_asserts": kept(ASSERT), "_routes": kept(ROUTE),
        "_keys": F.flatten(F.transform("_trim", lambda x: F.regexp_extract_all(x, F.lit("(?U)" + SETTING), F.lit(1)))),
    })

    def record(view: str, start: Column, end: Column, text: Column, level: int) -> Column:
        return F.struct(F.lit(view).alias("view"), i32(start).alias("start_line"), i32(end).alias("end_line"), text.alias("text"), F.lit(level).alias("data_level"))

    none = F.array().cast("array<struct<view:string,start_line:int,end_line:int,text:string,data_level:int>>")
    only = lambda test, made: F.when(test, F.array(made)).otherwise(none)
    joined = lambda rows, count: F.array_join(F.transform(F.slice(rows, 1, count), lambda s: s.x), "\n")
    each = lambda make: F.transform("_symbols", make)

    def documented(s: Column) -> Column:
        above = F.substr("_classes", n - s.line + 2)
        marks = F.regexp_extract(above, "^b*(c{1,3})", 1)
        last = s.line - 1 - F.length(F.regexp_extract(above, "^(b*)", 1))
        comment = F.slice("_trim", F.greatest(F.lit(1), i32(last - F.length(marks) + 1)), i32(F.length(marks)))
        header = F.element_at("_lines", s.line)
        text = F.regexp_replace(F.concat(F.array_join(comment, "\n"), F.lit("\n"), header), r"(?U)^\s+|\s+$", "")
        return record("signature_plus_doc", F.greatest(F.lit(1), s.line - 3), s.line, text, 1)

    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    plain = F.concat(F.lit("path "), path, F.lit(" language "), language, F.lit(" basename "), stem)
    symbol = lambda s: F.concat(F.lit("path "), path, F.lit(" language "), language, F.lit(" symbol "), s["name"], F.lit(" kind "), s.kind)
    named = F.when(F.size("_symbols") > 0, each(lambda s: record("path_plus_symbol", s.line, s.line, symbol(s), 0))).otherwise(
        F.array(record("path_plus_symbol", F.lit(1), F.least(F.lit(3), n), plain, 0)))
    raw = F.left(F.array_join(F.filter(F.slice("_lines", 1, RAW_LINES), lambda x: x.rlike(r"(?U)\S")), "\n"), F.lit(RAW_CHARS))
    comments, routes = c("_comments"), c("_routes")
    parts = {
        "path_plus_symbol": named,
        "signature_only": each(lambda s: record("signature_only", s.line, s.line, F.concat_ws(" ", s.kind, s["name"], F.element_at("_trim", s.line)), 1)),
        "signature_plus_doc": each(documented),
        "ast_header": each(lambda s: record("ast_header", s.line, F.least(n, s.line + 2), F.array_join(F.slice("_lines", s.line, 3), "\n"), 1)),
        "raw_code_trimmed": only(raw != "", record("raw_code_trimmed", F.lit(1), F.least(F.lit(RAW_LINES), n), raw, 1)),
        "comment_docstring": only(F.size(comments) > 0, record(
            "comment_docstring", F.get(comments, 0).i, F.get(comments, F.least(F.size(comments), F.lit(12)) - 1).i,
            F.left(joined(comments, COMMENT_LINES), F.lit(COMMENT_CHARS)), 1)),
        "test_name_plus_assert_terms": only(path.rlike(TEST_PATH) & (F.size("_asserts") > 0), record(
            "test_name_plus_assert_terms", F.lit(1), n, F.concat(F.lit("test file "), path, F.lit("\n"), joined(c("_asserts"), TERMS)), 1)),
        "config_key_plus_context": only(((language == "config") | path.rlike(CONFIG_PATH)) & (F.size("_keys") > 0), record(
            "config_key_plus_context", F.lit(1), F.least(n, F.lit(80)),
            F.concat(F.lit("config path "), path, F.lit(" keys "), F.array_join(F.slice("_keys", 1, KEYS), " ")), 1)),
        "route_plus_handler_signature": only(F.size(routes) > 0, record(
            "route_plus_handler_signature", F.get(routes, 0).i, F.least(n, F.get(routes, 0).i + 8),
            F.concat(F.lit("route handler path "), path, F.lit("\n"), joined(routes, ROUTES)), 1)),
    }
    built = told.select("repo_id", "path", "content_sha", "language", *[rows.alias(f"_v_{v}") for v, rows in parts.items()])
    first = F.slice(F.concat(*[F.slice(f"_v_{v}", 1, 2) for v in MIXED]), 1, 5)
    mixed = F.transform(first, lambda r: F.struct(
        F.lit("mixed_all_views").alias("view"), r.start_line.alias("start_line"), r.end_line.alias("end_line"), F.concat_ws("\n", r.view, r.text).alias("text"), r.data_level.alias("data_level")))
    numbered = [F.transform(rows, lambda r, i: F.struct((i + 1).alias("ordinal"), r.alias("r"))) for rows in [*[c(f"_v_{v}") for v in parts], mixed]]
    out = built.select("repo_id", "path", "content_sha", "language", F.explode(F.concat(*numbered)).alias("v"))
    return out.select("repo_id", "path", "v.r.view", "v.ordinal", "v.r.start_line", "v.r.end_line", "content_sha", "language", "v.r.text", "v.r.data_level")


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, int]:
    """A word's number and sign; a worker keeps those of the latest words."""
    digest = hashlib.sha256(word.encode("utf-8")).digest()
    return int.from_bytes(digest[:4], "little"), 1 if digest[4] % 2 == 0 else -1


def hashed_vector(text: str | None, dims: int = 256) -> np.ndarray:
    """Signed counts of a text's words, each at a place and with a sign by its
    SHA-256; not brought to unit length, so entries are whole numbers."""
    out = np.zeros(dims)
    for word in re.findall(WORD, (text or "").lower()):
        number, sign = _place(word)
        out[number % dims] += sign
    return out


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors, np.where(norms > 0, norms, 1)


def rank_views(views: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """task_id, view, rank, path, ordinal, start_line, end_line, score: for each
    task (task_id, repo_id, query) and view its k most similar records of the
    task's repository, by the cosine of hashed words, above 0; ties by path and
    ordinal.

    The tasks are a stated set: they go to the workers in blocks of TASK_BLOCK,
    one scan of the views a block. A worker makes the vectors of a batch, keeps
    each task's k best records of each view, and only those are shuffled. Null
    queries and texts are empty and match nothing, as do null repositories."""
    wanted = views.select("repo_id", "path", "view", "ordinal", "start_line", "end_line", "text")
    rows = iter(tasks.select("task_id", "repo_id", "query").where("task_id is not null and repo_id is not null").toLocalIterator())
    schema = "task_id long, view string, path string, ordinal int, start_line int, end_line int, score double"

    def scored(block: list) -> DataFrame:
        asked = [(r["task_id"], r["repo_id"], r["query"] or "") for r in block]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.array([a[0] for a in asked], np.int64)
            queries, q_norms = _unit(np.stack([hashed_vector(f"query {a[2]}") if a[2] else hashed_vector("") for a in asked]) if asked else np.zeros((0, 256)))
            repos = np.array([a[1] for a in asked], object)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    yield from best(whole.slice(at, 1024), ids, queries, q_norms, repos)

        def best(batch: pa.RecordBatch, ids, queries, q_norms, repos) -> Iterator[pa.RecordBatch]:
            vectors, norms = _unit(np.stack([hashed_vector(t) for t in batch.column("text").to_pylist()]))
            scores = np.round(queries @ vectors.T / (q_norms[:, None] * norms[None, :]), 6)
            # Records are in order of the tie rule, so a stable sort keeps to it.
            paths, ordinals = batch.column("path").to_pylist(), batch.column("ordinal").to_pylist()
            tie = np.array(sorted(range(batch.num_rows), key=lambda i: ((paths[i] or "").encode(), ordinals[i])))
            kinds, mine = np.array(batch.column("view").to_pylist(), object), np.array(batch.column("repo_id").to_pylist(), object)
            for kind in sorted(set(kinds)):
                at = tie[kinds[tie] == kind]
                part = np.where(repos[:, None] == mine[at][None, :], scores[:, at], 0.0)
                order = np.argsort(-part, axis=1, kind="stable")[:, :k]
                picked = np.take_along_axis(part, order, 1)
                who, where = np.nonzero(picked > 0)
                chosen = pa.array(at[order[who, where]])
                yield pa.RecordBatch.from_pydict({
                    "task_id": ids[who], **{c: batch.column(c).take(chosen) for c in ("view", "path", "ordinal", "start_line", "end_line")}, "score": picked[who, where]})

        return wanted.mapInArrow(task, schema)

    out = None
    while block := list(islice(rows, TASK_BLOCK)):
        out = scored(block) if out is None else out.unionByName(scored(block))
    out = scored([]) if out is None else out
    return ranked(out, [F.desc("score"), "path", "ordinal"], ["task_id", "view"], k).select("task_id", "view", "rank", "path", "ordinal", "start_line", "end_line", "score")


def rank_files(ranks: DataFrame, k: int) -> DataFrame:
    """task_id, rank, path, score, view: files by the best score of any of their
    records in ``ranks`` (of ``rank_views``), with the first view that has it."""
    best = ranks.groupBy("task_id", "path").agg(F.max("score").alias("score"), F.min_by("view", F.struct(-F.col("score"), F.col("view"))).alias("view"))
    return ranked(best, [F.desc("score"), "path"], ["task_id"], k).select("task_id", "rank", "path", "score", "view")
