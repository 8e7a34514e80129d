"""Composed plans: multi-channel retrieval and the four-turn context plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.size import bounded
from ..functions.storage import saved
from ..operators import evidence, fusion, graph, lexical, linesearch
from ..sources import corpus

CHANNELS = ("regex", "text", "bm25", "symbol", "graph")


def literal_hits(files: DataFrame, queries: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    """query_id, rank, path, start_line, end_line, score: lines that match a
    query, the first k by path and line of each kind; the kinds' lists follow one
    another in one list with ranks running on."""
    found = linesearch.line_hits(files, queries, kinds, k)
    place = reduce(lambda out, i: F.when(F.col("kind") == kinds[i], i).otherwise(out), range(len(kinds)), F.lit(None).cast("int"))
    first = lexical.ranked(found.withColumn("kind", place), ["path", "line_no"], ["query_id", "kind"], k)
    line = F.col("line_no").cast("long")
    listed = fusion.with_rank(first.withColumnRenamed("rank", "was"), ["query_id"], ["kind", "was"])
    return listed.select("query_id", "rank", "path", line.alias("start_line"), line.alias("end_line"), F.lit(1.0).alias("score"))


def graph_hits(hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges into each query's five most frequent files, first k by path and line."""
    top = fusion.top_paths(hits, 5).select("query_id", F.col("path").alias("target_path"))
    near = edges.join(top, "target_path").select(
        "query_id", F.col("source_path").alias("path"), F.col("source_line").alias("start_line"), F.col("source_line").alias("end_line")
    ).distinct()
    found = lexical.ranked(near, ["path", "start_line"], ["query_id"], k)
    return found.select("query_id", "rank", "path", "start_line", "end_line", F.lit(1.0).alias("score"), F.lit("graph").alias("channel"))


def channel_hits(files: DataFrame, queries: DataFrame, channels: tuple[str, ...], k: int, edges: DataFrame | None = None) -> DataFrame:
    """query_id, channel, rank, path, start_line, end_line, score of each channel.
    ``regex`` (the query as a pattern) and ``text`` (as it is) make one list,
    named regex; ``symbol`` gives lines that define the query as a name;
    ``graph`` follows ``edges`` (by default those of the files) from the files of
    the other channels, and of the regex list where it is asked for alone."""
    unknown = set(channels) - set(CHANNELS)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    cols = ["query_id", "rank", "path", "start_line", "end_line", "score"]
    named = lambda df, channel: df.select(*cols, F.lit(channel).alias("channel"))
    out = []
    kinds = tuple(c for c in ("regex", "text") if c in channels)
    if kinds:
        out.append(named(literal_hits(files, queries, kinds, k), "regex"))
    if "bm25" in channels:
        chunks = corpus.line_chunks(files)
        top = lexical.bm25(chunks, queries, 2 * k)
        tight = lexical.best_lines(top, chunks, queries).select(
            "query_id", "rank", "path", F.col("span_start").alias("start_line"), F.col("span_end").alias("end_line"), "score"
        )
        again = fusion.with_rank(tight.withColumnRenamed("rank", "was"), ["query_id"], ["was"]).where(F.col("rank") <= k)
        out.append(named(again, "bm25"))
    if "symbol" in channels:
        out.append(named(literal_hits(files, queries, ("symbol",), k), "symbol"))
    if "graph" in channels:
        seeds = out or [named(literal_hits(files, queries, ("regex",), k), "regex")]
        out.append(graph_hits(reduce(DataFrame.unionByName, seeds), graph.build_graph(files) if edges is None else edges, k))
    if not out:
        raise ValueError("no channel")
    return reduce(DataFrame.unionByName, out)


def retrieve(files: DataFrame, queries: DataFrame, channels: tuple[str, ...] = ("regex", "bm25", "symbol"), k: int = 20) -> DataFrame:
    """query_id, rank, path, start_line, end_line, score, channels: fused,
    wider spans absorbed, the k best of each query; all queries in one job."""
    fused = fusion.absorb_wider(saved(fusion.rrf(channel_hits(files, queries, channels, k)), "fused"))
    scored = fused.withColumn("score", F.round("score", 9))
    return lexical.ranked(scored, [F.desc("score"), "path", "start_line", "end_line"], ["query_id"], k)


def fast_context(files: DataFrame, queries: DataFrame, edges: DataFrame | None = None, k: int = 10, budget: int = 2000) -> DataFrame:
    """Four turns: lexical channels; symbols where the query looks like a name;
    edges into the five most frequent files; fusion, validity and token budget."""
    named = queries.where(lexical.has_identifier_tokens(F.col("query")))
    hits = channel_hits(files, queries, ("regex", "bm25"), k)
    if named.limit(1).count():
        hits = hits.unionByName(channel_hits(files, named, ("symbol",), k))
    hits = saved(hits, "hits")
    if edges is not None:
        hits = hits.unionByName(graph_hits(hits, edges, k))
    fused = fusion.absorb_wider(saved(fusion.rrf(hits), "fused")).withColumn("score", F.round("score", 9))
    best = saved(lexical.ranked(fused, [F.desc("score"), "path", "start_line", "end_line"], ["query_id"], k), "best")
    # Only the texts of files with a hit move on.
    near = files.join(bounded(best.select("path").distinct()), "path", "left_semi")
    valid = evidence.materialize(best.join(near.select("path", "content_sha"), "path"), near)
    return fusion.token_budget(valid, budget).select(
        "query_id", "rank", "path", "start_line", "end_line", "score", F.array_join("channels", ",").alias("channels"), "tokens", "used"
    )


def is_valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
