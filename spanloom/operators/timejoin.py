"""Joins in time: the last earlier row (as-of), and intervals that hold a point.

Neither pairs all rows. The as-of join sorts both sides together by key and
time, in range partitions, and carries the last right row forward; a partition
that begins inside a key gets what the partitions before it end with, so a key
with any share of the rows spreads over tasks. The interval join meets points
and intervals in buckets of time; an interval has one row for each bucket that
it touches, and a long one is held at a coarser level of buckets instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import scratch

#: Buckets of one level that an interval touches at most before it goes one level up, and the factor between levels.
TOUCHED, FACTOR = 16, 16


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: str, columns: list[str], right_key: str | None = None) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` with the same key and
    the latest time not after the left one's (of equal times the one with the
    largest ``order``); nulls where there is none, and for a null key or time.

    What is carried between partitions is one row for each of them, for the key
    that it begins with, so the broadcast is as small as their number."""
    kept = F.struct(*[F.col(c) for c in columns]).alias("_right")
    empty = F.lit(None).cast(right.select(kept).schema["_right"].dataType)
    # At one time right rows come first, so that a left row sees them.
    ours = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_order"), F.struct(*left.columns).alias("_left"), empty.alias("_right"))
    other = F.col(right_key or key)
    theirs = right.where(other.isNotNull() & F.col(right_time).isNotNull()).select(
        other.alias("_key"), F.col(right_time).cast(left.schema[left_time].dataType).alias("_time"), F.lit(0).alias("_side"), F.col(order).alias("_order"),
        F.lit(None).cast(ours.schema["_left"].dataType).alias("_left"), kept)
    whole = ours.where("_key IS NOT NULL AND _time IS NOT NULL").unionByName(theirs)
    by = ["_key", "_time", "_side", "_order"]
    # Written, so that every use sees the same partitions, also after a lost task.
    path = scratch(left.sparkSession, "asof")
    whole.repartitionByRange(*by, F.xxhash64("_left")).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    placed = left.sparkSession.read.parquet(path)
    own = Window.partitionBy("_part", "_key").orderBy("_time", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.withColumn("_last", F.last("_right", True).over(own))
    ends = placed.where("_side = 0").groupBy("_part", "_key").agg(F.max_by("_right", F.struct("_time", "_order")).alias("_before"))
    # Only a partition's first key can go on from an earlier partition.
    first = placed.groupBy("_part").agg(F.min("_key").alias("_key"))
    marks = ends.join(F.broadcast(first.select("_key").distinct()), "_key").select("_part", "_key", "_before", F.lit(1).alias("_end"))
    asked = first.select("_part", "_key", F.lit(None).cast(marks.schema["_before"].dataType).alias("_before"), F.lit(0).alias("_end"))
    until = Window.partitionBy("_key").orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.unionByName(asked).withColumn("_before", F.last("_before", True).over(until)).where("_end = 0").select("_part", "_key", "_before")
    joined = carried.where("_side = 1").join(F.broadcast(before), ["_part", "_key"], "left")
    found = joined.select("_left", F.coalesce("_last", "_before").alias("_right"))
    rest = ours.where("_key IS NULL OR _time IS NULL").select("_left", "_right")
    return found.unionByName(rest).select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and an interval with the same key where start <= at <
    end, all whole numbers. ``width`` is the length of the finest buckets."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(FACTOR), length / F.lit(float(width * TOUCHED))))).cast("int")
    size = lambda n: F.lit(width) * F.pow(F.lit(FACTOR), n).cast("long")
    spans = intervals.where(F.col(start) < F.col(end)).withColumn("_level", level)
    bucket = lambda c, n: F.floor(c / size(n))
    held = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start), F.col("_level")), bucket(F.col(end) - 1, F.col("_level")))))
    levels = spans.select("_level").distinct()
    # Levels grow with the logarithm of the longest interval, so they are few.
    asked = points.where(F.col(at).isNotNull()).join(F.broadcast(levels)).withColumn("_bucket", bucket(F.col(at), F.col("_level")))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return asked.join(held, [key, "_level", "_bucket"]).where(inside).drop("_level", "_bucket")
