"""Running totals of groups of any size.

A window would gather a group in one task. Here rows are put in order over range
partitions once, each partition adds up its own part of a group, and the parts'
totals (at most one row a partition and group) give each part its start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import scratch


def running_totals(df: DataFrame, by: list[str], order: list, weights: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with before_W and whole_W for each of ``weights``: W's sum over the
    earlier rows of the group ``by``, and over the group; nulls add nothing.

    ``order`` is a total order within a group: rows that are equal in it may
    swap places, and as equal rows can't be told apart by a range, they should
    be added up first where they can be many. Groups whose key is null are
    groups. Columns of the new names, and _part, are replaced.

    The ordered rows are written once below the shared folder, so both readers
    see the same partitions even when an executor is lost.
    """
    spark, path, zero = df.sparkSession, scratch(df.sparkSession, "ranks"), F.lit(0)
    plain = df.drop("_part", *[f"{x}_{w}" for w in weights for x in ("before", "whole")])
    keys = [*map(F.col, by), *order]
    laid = plain.repartitionByRange(parts, *keys) if parts else plain.repartitionByRange(*keys)
    laid.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = rows.groupBy(*by, "_part").agg(*[F.sum(F.coalesce(w, zero)).alias(f"_own_{w}") for w in weights])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"),
        *[F.coalesce(F.sum(f"_own_{w}").over(earlier), zero).alias(f"_start_{w}") for w in weights],
        *[F.sum(f"_own_{w}").over(group).alias(f"whole_{w}") for w in weights])
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"_in_{w}": F.coalesce(F.sum(F.coalesce(w, zero)).over(within), zero) for w in weights}).join(starts, same)
    befores = [(F.col(f"_in_{w}") + F.col(f"_start_{w}")).alias(f"before_{w}") for w in weights]
    return placed.select(*plain.columns, *befores, *[f"whole_{w}" for w in weights])


def value_places(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by``, ``value``, times, before, whole: each distinct value of a group,
    how often it stands there, how many rows have a smaller one, and how many
    the group has. Nulls come first."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("times"))
    got = running_totals(counted, by, [F.col(value)], ["times"])
    return got.withColumnsRenamed({"before_times": "before", "whole_times": "whole"})
