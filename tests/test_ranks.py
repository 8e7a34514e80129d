"""Running totals over range partitions against plain windows and lists."""

import math
import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import fusion, ranks, stats


def _rows(spark):
    rng = random.Random(3)
    # One group holds most rows, one value of it a third; null groups and values.
    rows = [("hot" if i % 5 else rng.choice(["a", "b", None]), None if i % 41 == 0 else 7.0 if i % 3 == 0 else float(rng.randrange(90)), i) for i in range(900)]
    return rows, spark.createDataFrame(rows, "g string, v double, i long")


def test_running_totals_equal_windows(spark):
    rows, df = _rows(spark)
    named = df.withColumn("before_v", F.lit("clash")).withColumn("_part", F.lit("clash"))
    got = ranks.running_totals(named, ["g"], [F.col("i")], ["v"], parts=7)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before_v", F.coalesce(F.sum("v").over(w), F.lit(0.0))).withColumn("whole_v", F.sum(F.coalesce("v", F.lit(0.0))).over(Window.partitionBy("g")))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_every_row_is_placed_once_in_parts(spark):
    df = spark.range(0, 2000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).cast("long").alias("w"))
    got = ranks.running_totals(df, ["g"], [F.col("id")], ["w"], parts=9)
    assert got.where("before_w <> id div 2 or whole_w <> 1000").count() == 0 and got.count() == 2000


def test_percentiles_and_tails_of_hot_groups(spark):
    rows, df = _rows(spark)
    known = df.where("v is not null")
    lists = {g: sorted(v for h, v, _ in rows if h == g and v is not None) for g in ("hot", "a", "b", None)}
    for p in (0, 50, 95, 100):
        got = {r["g"]: r for r in stats.percentiles(known, "v", ["g"], p).collect()}
        assert set(got) == set(lists)
        for g, vs in lists.items():
            n = len(vs)
            at = p * (n - 1) / 100
            low = math.floor(at)
            linear = vs[low] + (at - low) * (vs[min(low + 1, n - 1)] - vs[low])
            assert (got[g]["p_floor"], got[g]["p_index"], got[g]["n"]) == (vs[low], vs[min(n * p // 100, n - 1)], n)
            assert math.isclose(got[g]["p_linear"], linear)
    for alpha in (0.0, 0.1, 1.0):
        for r in stats.cvar(known, "v", ["g"], alpha).collect():
            k = max(1, round(alpha * len(lists[r["g"]])))
            assert r["n_worst"] == k and math.isclose(r["cvar"], statistics.fmean(lists[r["g"]][:k]))


def test_sketch_is_within_its_bound_and_nulls_count_nothing(spark):
    _, df = _rows(spark)
    got = stats.sketch_errors(df, "v", ["g"], 95, accuracy=50).collect()
    assert len(got) == 4 and all(r["within"] for r in got)


def test_no_rows(spark):
    _, df = _rows(spark)
    none = df.where("i < 0")
    assert stats.percentiles(none, "v", ["g"], 95).count() == stats.cvar(none, "v", ["g"], 0.1).count() == 0
    assert stats.holdout_split(none, "g", 2).count() == 0


def test_holdout_takes_the_first_groups(spark):
    _, df = _rows(spark)
    split = lambda n: {r["g"]: r["split"] for r in stats.holdout_split(df, "g", n).collect()}
    assert split(0) == dict.fromkeys((None, "a", "b", "hot"), "test")
    assert split(1) == {None: "train", "a": "test", "b": "test", "hot": "test"}
    assert split(3) == {None: "train", "a": "train", "b": "train", "hot": "test"}


def test_budget_prefix_equals_the_window(spark):
    _, df = _rows(spark)
    items = df.where("g is not null").select("g", "i", F.repeat(F.lit("x"), (F.col("i") % 9).cast("int")).alias("excerpt"))
    want = fusion.token_budget(fusion.with_rank(items, ["g"], ["i"]), 60, key="g").select("g", "i", "rank", "tokens", "used")
    got = fusion.budget_prefix(items, 60, "g", [F.col("i")]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
