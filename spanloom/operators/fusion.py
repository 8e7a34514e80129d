"""Reciprocal-rank fusion and what is done to fused lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running_totals

RRF_K = 60
SPAN = ["query_id", "path", "start_line", "end_line"]


def with_rank(hits: DataFrame, keys: list[str], by: list) -> DataFrame:
    """Adds rank, the place in a list, by an explicit total order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def rrf(ranked: DataFrame, keys: list[str] = SPAN, k: int = RRF_K) -> DataFrame:
    """``keys``, score, channels, n_hits from rows (keys, channel, rank)."""
    return ranked.groupBy(*keys).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_set("channel")).alias("channels"), F.count("*").alias("n_hits"),
    )


def absorb_wider(fused: DataFrame) -> DataFrame:
    """Spans that contain another span of their query and path give it their
    score and channels and go. Survivors contain no span; a wider span counts
    once, for the shortest survivor in it (then by start and end).

    The joins are by query and path, so work grows with a file's hits only."""
    a, b = fused.alias("a"), fused.alias("b")
    inside = (
        (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.path") == F.col("b.path"))
        & (F.col("a.start_line") <= F.col("b.start_line")) & (F.col("a.end_line") >= F.col("b.end_line"))
        & ((F.col("a.start_line") < F.col("b.start_line")) | (F.col("a.end_line") > F.col("b.end_line")))
    )
    lasting = a.join(b, inside, "left_anti")
    gone = a.join(b, inside, "left_semi")
    into = (
        gone.alias("a").join(lasting.alias("b"), inside)
        .groupBy(*[F.col(f"a.{c}") for c in SPAN], F.col("a.score").alias("score"), F.col("a.channels").alias("channels"))
        .agg(F.min(F.struct(
            (F.col("b.end_line") - F.col("b.start_line")).alias("n"), F.col("b.start_line").alias("start_line"),
            F.col("b.end_line").alias("end_line"),
        )).alias("to"))
        .select("query_id", "path", "to.start_line", "to.end_line", "score", "channels")
    )
    return (
        lasting.select(*SPAN, "score", "channels").unionByName(into).groupBy(*SPAN)
        .agg(F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"))
    )


def dedupe_first(items: DataFrame, keys: list[str]) -> DataFrame:
    """The first row by rank for each key, ranks closed up."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("_n = 1").drop("_n")
    return first


def top_paths(items: DataFrame, n: int, key: str = "query_id") -> DataFrame:
    """The n paths of each query with most rows, then best score, then path."""
    counted = items.groupBy(key, "path").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))
    window = Window.partitionBy(key).orderBy(F.desc("n_hits"), F.desc("best"), "path")
    return counted.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def token_budget(items: DataFrame, budget: int, key: str = "query_id", text: str = "excerpt") -> DataFrame:
    """The longest prefix by rank whose token estimates (bytes / 4, rounded up)
    fit the budget: stopping at the first overflow is a running sum."""
    cost = F.expr(f"(octet_length({text}) + 3) div 4")
    window = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(window)).where(F.col("used") <= budget)


def budget_prefix(items: DataFrame, budget: int, key: str, order: list, text: str = "excerpt") -> DataFrame:
    """``items`` without ``text``, with rank, tokens and used, as ``with_rank``
    and then ``token_budget`` give them, for lists of any length: running totals
    over range partitions. Texts don't move; ``order`` is total in a list. A
    null text has null tokens and counts as nothing."""
    cost = F.expr(f"(octet_length({text}) + 3) div 4")
    lean = items.withColumn("tokens", cost).withColumn("_one", F.lit(1).cast("long")).drop(text)
    spent = running_totals(lean, [key], order, ["tokens", "_one"])
    used = F.col("before_tokens") + F.coalesce("tokens", F.lit(0))
    kept = spent.withColumn("used", used).withColumn("rank", F.col("before__one") + 1).where(F.col("used") <= budget)
    return kept.select(*[c for c in lean.columns if c != "_one"], "rank", "used")
