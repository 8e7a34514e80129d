"""Mined task features and hard negatives: what names, files and edges share
with queries and with one another, by substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.size import bounded
from .lexical import ranked
from .manypatterns import containing

#: Tokens of a query, and words that ask for an interface or a setting.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]{2,}"
API_WORDS = r"(?i)\b(api|config|key|route|handler|timeout)\b"


def _held(texts: Column, rows: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """``key``, token: which rows' texts hold which of the tokens."""
    asked = tokens.select("token").distinct().withColumn("id", F.xxhash64("token"))
    got = containing(rows.select(F.col(key).alias("key"), texts.alias("text")), asked.select("id", F.col("token").alias("pattern")))
    return got.join(asked, "id").select(F.col("key").alias(key), "token")


def query_tokens(tasks: DataFrame) -> DataFrame:
    """task_id, token: the distinct lower-case tokens of each query."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(TOKEN), F.lit(0)), F.lower))
    return tasks.select("task_id", F.explode(found).alias("token"))


def graph_support(tasks: DataFrame, edges: DataFrame, paths: int = 5) -> DataFrame:
    """task_id, support_count, support_paths, edge_types, confidence_boost: the
    edges (edge, src, dst) of which an end holds a token of the query, the first
    ``paths`` of their sources, and their kinds. Tasks without an edge count 0."""
    tokens = query_tokens(tasks)
    ends = F.lower(F.concat_ws("\n", "src", "dst"))
    distinct = edges.select("src", "dst").distinct().withColumn("_ends", F.struct("src", "dst"))
    held = _held(ends, distinct, tokens, "_ends").join(bounded(tokens), "token").select("task_id", "_ends.src", "_ends.dst").distinct()
    met = held.join(edges.select("edge", "src", "dst"), ["src", "dst"])
    counts = met.groupBy("task_id").agg(F.count("*").alias("support_count"), F.array_sort(F.collect_set("edge")).alias("edge_types"))
    sources = ranked(met.select("task_id", "src").distinct(), ["src"], ["task_id"], paths)
    first = sources.groupBy("task_id").agg(F.array_sort(F.collect_list("src")).alias("support_paths"))
    got = tasks.select("task_id").join(counts, "task_id", "left").join(first, "task_id", "left")
    n, none = F.coalesce("support_count", F.lit(0)), F.array().cast("array<string>")
    return got.select(
        "task_id", n.alias("support_count"), F.coalesce("support_paths", none).alias("support_paths"), F.coalesce("edge_types", none).alias("edge_types"),
        F.least(F.lit(0.2), F.round(n * 0.03, 2)).alias("confidence_boost"))


def lexical_features(tasks: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """task_id, regex_hits (files whose path or text holds a token), path_score,
    symbol_hits (symbols whose name holds a token or is held by one),
    identifier_density, proper_names, api_config."""
    tokens = query_tokens(tasks)
    count = lambda held, key, name: held.join(bounded(tokens), "token").groupBy("task_id").agg(F.countDistinct(key).alias(name))
    texts = count(_held(F.lower(F.concat_ws("\n", "path", "content")), files, tokens, "path"), "path", "regex_hits")
    paths = count(_held(F.lower("path"), files, tokens, "path"), "path", "path_hits")
    names = symbols.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))
    inside = _held(F.col("name"), names, tokens, "name")
    around = containing(
        tokens.select("token").distinct().select(F.col("token").alias("key"), F.col("token").alias("text")),
        names.select(F.xxhash64("name").alias("id"), F.col("name").alias("pattern")),
    ).join(names.select(F.xxhash64("name").alias("id"), "name"), "id").select("name", F.col("key").alias("token"))
    near = inside.unionByName(around).join(bounded(tokens), "token").select("task_id", "name").distinct()
    hits = near.join(names, "name").groupBy("task_id").agg(F.sum("n").alias("symbol_hits"))
    found = F.regexp_extract_all("query", F.lit(TOKEN), F.lit(0))
    distinct = F.greatest(F.lit(1), F.size(F.array_distinct(F.transform(found, F.lower))))
    upper = F.size(F.filter(found, lambda t: t.rlike("^[A-Z]")))
    got = tasks.join(texts, "task_id", "left").join(paths, "task_id", "left").join(hits, "task_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return got.select(
        "task_id", zero("regex_hits").alias("regex_hits"), F.least(F.lit(1.0), zero("path_hits") / 3).alias("path_score"), zero("symbol_hits").alias("symbol_hits"),
        (F.size(F.array_distinct(F.transform(found, F.lower))) / distinct).alias("identifier_density"), (upper / distinct).alias("proper_names"),
        F.when(F.col("query").rlike(API_WORDS), 1.0).otherwise(0.0).alias("api_config"))


def hard_negatives(symbols: DataFrame, n: int = 2) -> DataFrame:
    """place, negative, kind, rank: for each symbol (place, path, name; place is
    a total order) its first ``n`` hard negatives: other names of its file, and
    as far as those are too few, symbols of other files of which one name holds
    the other, without regard to case.

    Names meet through an automaton. Of a file's names, and of a name's files,
    only as many rows go on as can be among the first ``n`` of any symbol."""
    cut = lambda df, inner, outer: ranked(ranked(df, ["place"], inner, n).drop("rank"), ["place"], outer, 2 * n).drop("rank")
    rows = symbols.select("place", "path", "name", F.lower("name").alias("low"))
    own = cut(rows.select("path", "name", "place"), ["path", "name"], ["path"])
    same = rows.alias("a").join(own.alias("b"), "path").where("a.name <> b.name").select(F.col("a.place").alias("place"), F.col("b.place").alias("negative"), F.lit("same_file").alias("kind"))
    names = rows.select("low").distinct()
    holds = containing(names.select(F.col("low").alias("key"), F.col("low").alias("text")), names.select(F.xxhash64("low").alias("id"), F.col("low").alias("pattern")))
    pairs = holds.join(names.select(F.xxhash64("low").alias("id"), "low"), "id").select(F.col("key").alias("a"), F.col("low").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    first = cut(rows.select("low", "path", "place"), ["low", "path"], ["low"])
    like = cut(both.join(first, F.col("b") == F.col("low")).select("a", "path", "place"), ["a", "path"], ["a"])
    similar = rows.alias("s").join(like.alias("t"), (F.col("s.low") == F.col("t.a")) & (F.col("s.path") != F.col("t.path"))).select(
        F.col("s.place").alias("place"), F.col("t.place").alias("negative"), F.lit("similar_name").alias("kind"))
    return ranked(same.unionByName(similar), ["kind", "negative"], ["place"], n)
