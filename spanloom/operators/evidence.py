"""Evidence: the only gate from hits to citations, and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _verdict(check_excerpt: bool) -> Column:
    total = F.size("ls")
    out = (
        F.when(F.coalesce("content_sha", F.lit("")) == "", "empty_sha")
        .when(~T.is_safe_path(F.col("path")), "path_unsafe")
        .when(F.col("current_sha").isNull(), "file_missing")
        .when(F.col("content_sha") != F.col("current_sha"), "stale_content")
        .when((F.col("start_line") < 1) | (F.col("start_line") > F.col("end_line")) | (F.col("end_line") > total), "bad_range")
    )
    if check_excerpt:
        differs = F.col("excerpt").isNotNull() & (F.col("excerpt") != F.col("lines"))
        out = out.when(differs, "excerpt_mismatch")
    return F.coalesce(out, F.lit("ok"))


def checked(hits: DataFrame, files: DataFrame, check_excerpt: bool = False) -> DataFrame:
    """``hits`` with reason (ok, or the first check that fails, in fixed order)
    and the current lines of valid spans. Ranges are never cut to fit."""
    now = files.select("path", F.col("content_sha").alias("current_sha"), T.lines(F.col("content")).alias("ls"))
    span = F.when(
        (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")),
        F.array_join(F.slice("ls", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n"),
    )
    joined = hits.join(now, "path", "left").withColumn("lines", span).withColumn("reason", _verdict(check_excerpt))
    return joined.withColumn("lines", F.when(F.col("reason") == "ok", F.col("lines"))).drop("ls", "current_sha")


def materialize(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Only valid hits, with their excerpt."""
    return checked(hits, files).where("reason = 'ok'").withColumnRenamed("lines", "excerpt").drop("reason")


def validity_ratio(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Counts by reason of all citations."""
    return checked(citations, files, "excerpt" in citations.columns).groupBy("reason").count()
