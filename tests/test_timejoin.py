"""As-of and interval joins against plain Python."""

import random

from spanloom.operators import timejoin


def test_asof_over_many_partitions(spark):
    rnd = random.Random(6)
    left = [(i, rnd.choice((1, 1, 1, 2, 3, None)), rnd.choice((None, *range(60)))) for i in range(300)]
    right = [(rnd.choice((1, 1, 2, 4, None)), rnd.choice((None, *range(0, 60, 3))), n, rnd.choice(("a", None))) for n in range(200)]
    right += right[:5]
    ours = spark.createDataFrame(left, "id int, k int, t int")
    theirs = spark.createDataFrame(right, "k int, u int, n int, v string")
    want = []
    for i, k, t in left:
        fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(fits, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((i, k, t, best[2], best[3]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = timejoin.asof_join(ours, theirs, "k", "t", "u", "n", ["n", "v"])
            assert got.columns == ["id", "k", "t", "n", "v"]
            assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert timejoin.asof_join(ours.where("false"), theirs, "k", "t", "u", "n", ["n"]).collect() == []
    alone = timejoin.asof_join(ours, theirs.where("false"), "k", "t", "u", "n", ["n"])
    assert sorted(map(tuple, alone.collect())) == sorted((*r, None) for r in left)


def test_intervals_of_all_lengths(spark):
    rnd = random.Random(7)
    points = [(i, rnd.choice((1, 2)), rnd.choice((None, rnd.randrange(-500, 5000)))) for i in range(200)]
    spans = [(n, rnd.choice((1, 2, 3)), s := rnd.randrange(-600, 4000), s + rnd.choice((-3, 0, 1, 10, 100, 1000, 100_000))) for n in range(150)]
    got = timejoin.interval_join(
        spark.createDataFrame(points, "id int, k int, at long"), spark.createDataFrame(spans, "n int, k int, a long, b long"), "k", "at", "a", "b", 5)
    want = [(k, i, at, n, a, b) for i, k, at in points for n, other, a, b in spans if at is not None and k == other and a <= at < b]
    assert sorted((r["k"], r["id"], r["at"], r["n"], r["a"], r["b"]) for r in got.collect()) == sorted(want)
