"""Line search for many queries at once: as patterns, as they are, as names."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from re import _parser as patterns_of

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import symbol_patterns
from .manypatterns import automaton_of, each_piece, pieces_of, read_piece

#: Kinds of line search: the query as a pattern, as it is, as a defined name.
KINDS = ("regex", "text", "symbol")


def required_literal(pattern: str) -> str | None:
    """The longest run of characters that every match holds, as far as the
    pattern's outer sequence shows it; None for what is no pattern."""
    try:
        re.compile(pattern)
        parsed = patterns_of.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ""
    runs = [""]
    for op, value in parsed:
        if op is patterns_of.LITERAL:
            runs[-1] += chr(value)
        elif op is not patterns_of.AT:
            runs.append("")
    return max(runs, key=len)


class LineSearch:
    """Compiled line searches of a piece of queries. Only lines in which a
    query's required literal ends are looked at again; queries without one are
    tried on every line, and invalid patterns match none."""

    def __init__(self, ids: list, queries: list[str], kinds: tuple[str, ...]):
        self.asked, literals, self.always = [], [], []
        for query_id, query in zip(ids, queries):
            for kind in kinds:
                literal = required_literal(query) if kind == "regex" else query
                if literal is None:
                    continue
                test = re.compile(query).search if kind == "regex" else None
                if kind == "symbol":
                    test = [(language, re.compile(p).search) for language, _, p in symbol_patterns(query)]
                if not literal:
                    self.always.append(len(self.asked))
                self.asked.append((query_id, kind, query, test))
                literals.append(literal)
        self.automaton = automaton_of(literals)

    def hits(self, text: str, language: str | None, most: int | None) -> list[tuple[int, str, int]]:
        """(query id, kind, line number) in line order for each query and kind, the first ``most``."""
        if not text:
            return []
        lines = text.removesuffix("\n").split("\n")
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        near = {(i, n) for i in self.always for n in range(len(lines))}
        if self.automaton is not None:
            for end, places in self.automaton.iter(text):
                n = bisect.bisect_right(starts, end) - 1
                near.update((i, n) for i in places)
        out, given = [], {}
        for i, n in sorted(near):
            query_id, kind, query, test = self.asked[i]
            if most is not None and given.get(i, 0) >= most:
                continue
            line = lines[n].removesuffix("\r")
            if kind == "symbol":
                good = any(search(line) for of, search in test if language in (of, "unknown"))
            else:
                good = test(line) if kind == "regex" else query in line
            if good:
                given[i] = given.get(i, 0) + 1
                out.append((query_id, kind, n + 1))
        return out


def line_hits(files: DataFrame, queries: DataFrame, kinds: tuple[str, ...] = ("regex", "text"), most: int | None = None) -> DataFrame:
    """query_id, kind, path, line_no: the lines that match each query (query_id,
    query) by each kind; with ``most`` only so many, the first ones, of a file.

    ``regex`` takes the query as a pattern (queries that are none find nothing),
    ``text`` as it is, ``symbol`` as a name that the line defines."""
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")

    def task_of(uri: str):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries = read_piece(uri)
            search = LineSearch(ids, queries, kinds)
            for batch in batches:
                rows, found = [], []
                for row, (text, language) in enumerate(zip(batch.column("content").to_pylist(), batch.column("language").to_pylist())):
                    got = search.hits(text, language, most)
                    rows += [row] * len(got)
                    found += got
                query_id, kind, line_no = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id, pa.int64()), pa.array(kind, pa.string()), batch.column("path").take(pa.array(rows, pa.int64())), pa.array(line_no, pa.int32())],
                    names=["query_id", "kind", "path", "line_no"],
                )
        return task

    asked = queries.where("query is not null").select(F.col("query_id").cast("long").alias("id"), F.col("query").alias("pattern"))
    texts = files.select("path", "language", "content").where("content is not null")
    return each_piece(texts, pieces_of(asked), task_of, "query_id long, kind string, path string, line_no int")
