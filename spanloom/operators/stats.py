"""Statistics: percentiles, tails, weighted means, bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_places


def percentiles(df: DataFrame, value: str, by: list[str], p: int) -> DataFrame:
    """Three definitions of the p-th percentile: p_floor takes index
    floor(p (n - 1) / 100), p_index takes int(n p / 100) capped, p_linear
    interpolates. Exact; a group's values are never in one task."""
    c = F.col
    places = value_places(df, value, by)
    at = lambda index: (c("before") <= index) & (index < c("before") + c("times"))
    pick = lambda index: F.max(F.when(at(index), c(value)))
    low = F.expr(f"({p} * (whole - 1)) div 100")
    index = F.least(F.expr(f"(whole * {p}) div 100"), c("whole") - 1)
    share = F.lit(p) * (c("whole") - 1) / 100 - low
    part = F.when(at(low), c(value) * (1 - share)), F.when(at(low + 1) & (share > 0), c(value) * share)
    return places.groupBy(*by).agg(
        pick(low).alias("p_floor"), pick(index).alias("p_index"),
        (F.sum(part[0]) + F.coalesce(F.sum(part[1]), F.lit(0.0))).alias("p_linear"), F.sum("times").alias("n"),
    )


def sketch_errors(df: DataFrame, value: str, by: list[str], p: int, accuracy: int = 10_000) -> DataFrame:
    """``by``, sketch, rank_error, within: the p-th percentile by a sketch of
    bounded size, by how many rows its place misses ceil(n p / 100), and whether
    that keeps to the sketch's bound, n / accuracy (one row at least)."""
    c = F.col
    guess = df.groupBy(*by).agg(F.percentile_approx(c(value).cast("double"), F.lit(p / 100), F.lit(accuracy)).alias("sketch"))
    ours = [c(f"_by_{i}") for i in range(len(by))]
    guess = guess.select(*[c(k).alias(f"_by_{i}") for i, k in enumerate(by)], "sketch")
    same = F.lit(True)
    for k, mine in zip(by, ours):
        same = same & c(k).eqNullSafe(mine)
    known = value_places(df.where(c(value).isNotNull()), value, by).join(guess, same).where(c(value).cast("double") == c("sketch"))
    wanted = F.expr(f"(whole * {p} + 99) div 100")
    missed = F.greatest(F.lit(0), c("before") + 1 - wanted, wanted - c("before") - c("times"))
    return known.select(*by, "sketch", missed.alias("rank_error"), (missed <= F.greatest(F.lit(1), F.ceil(c("whole") / accuracy))).alias("within"))


def cvar(df: DataFrame, value: str, by: list[str], alpha: float) -> DataFrame:
    """The mean of the worst (lowest) max(1, round(alpha n)) values, halves
    rounded to even. A group's values are never in one task."""
    c = F.col
    k = F.greatest(F.lit(1), F.bround(F.lit(alpha) * c("whole"), 0).cast("long"))
    taken = F.least(c("times"), k - c("before"))
    worst = value_places(df, value, by).withColumn("_taken", taken).where("_taken > 0")
    known = F.sum(F.when(c(value).isNotNull(), c("_taken")))
    return worst.groupBy(*by).agg((F.sum(c(value) * c("_taken")) / known).alias("cvar"), F.sum("_taken").alias("n_worst"))


def worst_group(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """The lowest group mean, its group, and the spread of the group means."""
    means = df.groupBy(*by, group).agg(F.round(F.avg(value), 9).alias("m"))
    return means.groupBy(*by).agg(
        F.min(F.struct("m", group)).alias("w"), (F.max("m") - F.min("m")).alias("spread"), F.avg("m").alias("mean_of_groups")
    ).select(*by, F.col(f"w.{group}").alias("worst_group"), F.col("w.m").alias("worst_mean"), "spread", "mean_of_groups")


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    total = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    return df.groupBy(*by).agg(total.alias("weighted_mean"))


def _counts_of_draws() -> np.ndarray:
    """The Poisson(1) count of each 16-bit draw, by its distribution function."""
    bounds = np.cumsum([1 / (math.e * math.factorial(k)) for k in range(9)])
    return np.searchsorted(bounds, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def poisson_weights(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row (a 64-bit hash) is drawn in each resample, rows by
    resamples. Four draws come from a word: the hash stepped on by a counter and
    mixed, so that a row's draws depend on its hash alone."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[:, None] + np.arange(1, (resamples + 3) // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return _DRAWN[x.view(np.uint16)[:, :resamples]]


_DRAWN = _counts_of_draws()
#: Bytes of running sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20


#: Values are summed as whole numbers and fractions in these steps, both in
#: integers, so that sums don't depend on the order of tasks.
FRACTION = 1 << 30


def _resampled(by: list[str], resamples: int):
    """A task's sums: for each group the vectors of weighted values (wholes and
    fractions) and weights, all whole numbers."""
    step = max(1, (1 << 20) // max(resamples, 1))
    most = max(1, HELD_BYTES // (24 * max(resamples, 1)))

    def batch_of(held: dict) -> pa.RecordBatch:
        keys = pa.concat_tables([x[3] for x in held.values()])
        sums = [pa.array([x[i] for x in held.values()], pa.list_(pa.int64())) for i in (0, 1, 2)]
        return pa.RecordBatch.from_arrays([keys[c].combine_chunks() for c in by] + sums, [*by, "wholes", "parts", "weights"])

    def task(batches):
        held: dict = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            keys = rows.select(by)
            places = keys.append_column("_i", pa.array(np.arange(rows.num_rows))).group_by(by).aggregate([("_i", "list")])
            hashes, values = rows["_h"].to_numpy(), rows["_v"].to_numpy()
            whole = np.floor(values)
            part_of = np.rint((values - whole) * FRACTION)
            for at in places["_i_list"].to_pylist():
                own = keys.slice(at[0], 1)
                name = tuple(own.to_pylist()[0].values())
                if name not in held:
                    if len(held) >= most:
                        yield batch_of(held)
                        held = {}
                    held[name] = (*(np.zeros(resamples, np.int64) for _ in range(3)), own)
                wholes, parts, weights, _ = held[name]
                for i in range(0, len(at), step):
                    rows_at = np.array(at[i:i + step])
                    drawn = poisson_weights(hashes[rows_at], resamples).astype(np.float64)
                    # Products of whole numbers below 2^53 are exact in doubles.
                    wholes += (whole[rows_at] @ drawn).astype(np.int64)
                    parts += (part_of[rows_at] @ drawn).astype(np.int64)
                    weights += drawn.sum(axis=0).astype(np.int64)
        if held:
            yield batch_of(held)

    return task


def bootstrap_means(df: DataFrame, value: str, key: str, by: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """``by``, resample, mean. Each row is drawn a Poisson(1) number of times in
    each resample, from a hash of its key, which needs no row numbers and does
    not depend on partitioning; rows of one key are drawn together. Rows without
    a finite value are left out; chances are in steps of 2^-16, values in steps of
    2^-30, and sums in whole numbers, so any order of the rows gives the same
    means.

    A task keeps one pair of vectors a group, so rows are never multiplied by
    the resamples, and what is shuffled grows with the tasks only."""
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    rows = df.where(finite).select(*by, F.xxhash64(F.lit(seed), F.col(key)).alias("_h"), number.alias("_v"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(by)])
    sums = rows.mapInArrow(_resampled(by, resamples), f"{types}, wholes array<long>, parts array<long>, weights array<long>")
    each = sums.select(*by, F.posexplode(F.arrays_zip("wholes", "parts", "weights")).alias("resample", "s"))
    added = each.groupBy(*by, "resample").agg(*(F.sum(f"s.{c}").alias(c) for c in ("wholes", "parts", "weights")))
    mean = (F.col("wholes") + F.col("parts") / FRACTION) / F.nullif(F.col("weights"), F.lit(0))
    return added.select(*by, "resample", mean.alias("mean"))


def bootstrap_interval(df: DataFrame, value: str, key: str, by: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``by``, low, high, positive and negative shares of the resampled means."""
    tail = (1 - level) / 2
    means = bootstrap_means(df, value, key, by, resamples, seed)
    return means.groupBy(*by).agg(
        F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"),
        F.avg((F.col("mean") > 0).cast("double")).alias("positive"), F.avg((F.col("mean") < 0).cast("double")).alias("negative"),
    )


def holdout_split(df: DataFrame, group: str, n_train: int) -> DataFrame:
    """group, split: the first n groups in order train, the rest tests; null is
    the first of all. Only the last group that trains is sent round."""
    groups = df.select(group).distinct()
    last = groups.orderBy(group).limit(n_train).agg(F.max(group).alias("_last"), F.count("*").alias("_n"))
    trains = (F.col("_n") > 0) & (F.col(group).isNull() | F.coalesce(F.col(group) <= F.col("_last"), F.lit(False)))
    return groups.crossJoin(F.broadcast(last)).select(group, F.when(trains, "train").otherwise("test").alias("split"))
