"""Rules on lists, paths and routes, against rows worked out by hand."""

from pyspark.sql import functions as F

from spanloom.operators import hybrids, metrics, packing, policies


def items(spark, paths):
    return spark.createDataFrame([("s", 1, r, p, 1, 2) for r, p in enumerate(paths, 1)], "strategy string, task_id long, rank long, path string, start_line long, end_line long")


def orders(spark, paths, old):
    pool = spark.createDataFrame([("s", 1, p) for p in old], "strategy string, task_id long, path string")
    out = {}
    for row in packing.difference_aware(items(spark, paths), pool).orderBy("rule", "new_rank").collect():
        out.setdefault(row["rule"], []).append(row["rank"])
    return out


def test_mixed_orders(spark):
    # Old files at 1, 2 and 6; the novel ones are 3, 4, 5 and 7 to 12, of which 8 repeats 7.
    got = orders(spark, ["o1", "o2", "a", "b", "c", "o3", "d", "d", "e", "f", "g", "h"], ["o1", "o2", "o3"])
    full = [3, 4, 5, 7, 8, 9, 10, 11, 12, 1, 2, 6]
    guarded = [1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 6, 8]
    assert got["full8_guard2"] == [3, 4, 5, 7, 8, 9, 10, 11, 1, 2, 6, 12]
    assert got["guard3_full7"] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 6, 12]
    assert got["dup_guard"] == full and got["novel_top5_guard"] == full
    assert got["keep_top5_guard"] == guarded and got["deep_full"] == guarded and got["deep_full8"] == guarded
    assert got["dup_or_few_novel_guard"] == full


def test_choices_by_list(spark):
    got = orders(spark, ["a", "a", "b", "c", "d"], [])
    assert got["dup_guard"] == [1, 2, 3, 4, 5]
    deep = orders(spark, ["o", *"abcdefghijkl"], ["o"])
    assert deep["deep_full"] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 1, 12, 13]
    assert deep["deep_full8"] == [2, 3, 4, 5, 6, 7, 8, 9, 1, 10, 11, 12, 13]


def test_paths(spark):
    rows = [(1, "r", "r/a"), (1, "r", "a"), (1, "r", "r/r/a"), (1, "", "r/a"), (1, None, "a"), (2, "r", None)]
    predicted = spark.createDataFrame(rows, "task_id long, repo_id string, path string")
    labels = spark.createDataFrame([(1, "a")], "task_id long, path string")
    got = {(r["task_id"], r["repo_id"], r["path"]): r["matched"] for r in hybrids.path_matches(predicted, labels).collect()}
    assert got == {(1, "r", "r/a"): True, (1, "r", "a"): True, (1, "r", "r/r/a"): False, (1, "", "r/a"): False, (1, None, "a"): True, (2, "r", None): False}
    risky = spark.createDataFrame([("x/tests/a.rs",), ("a/b.lock",), ("docs",), ("src/latest.rs",), ("",), (None,)], "p string")
    assert [r[0] for r in risky.select(hybrids.risk_bucket(F.col("p"))).collect()] == ["risk_penalty", "risk_penalty", "risk_penalty", "normal", "unknown", "unknown"]


def test_filters_fall_back(spark):
    rows = [(1, "run pytest", "src/a.rs", "rust", "x"), (1, "run pytest", "src/b.rs", "rust", "RUN"), (2, "rust code", "t/c.rs", "rust", None), (2, "rust code", "d.py", None, "y"), (3, "a b", "e.py", "python", None)]
    pairs = spark.createDataFrame(rows, "query_id long, query string, path string, language string, text string")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(hybrids.layout_filter(pairs, "per_language")) == ["e.py", "src/a.rs", "src/b.rs", "t/c.rs"]
    assert paths(hybrids.layout_filter(pairs, "source_vs_test_split")) == ["d.py", "e.py", "src/a.rs", "src/b.rs", "t/c.rs"]
    assert paths(hybrids.anchor_filter(pairs)) == ["e.py", "src/b.rs"]


def test_hybrids_without_anchors(spark):
    rows = [("v", 1, 1, "a", 1, 2), ("v", 1, 2, "b", 1, 2), ("rrf", 1, 1, "b", 1, 2), ("v", 2, 1, "a", 1, 2), ("v", 3, 1, "a", 5, 6), ("regex", 3, 1, "a", 1, 2)]
    p = spark.createDataFrame(rows, "strategy string, task_id long, rank long, path string, start_line long, end_line long")
    noisy = spark.createDataFrame([(3,)], "task_id long")
    got = {}
    for r in hybrids.hybrid_strategies(p, noisy, "v").collect():
        got.setdefault(r["strategy"], []).append((r["task_id"], r["rank"], r["path"]))
    assert sorted(got["only"]) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a")]
    assert got["in_fused_files"] == [(1, 1, "b")] and got["in_symbol_regex_files"] == [(3, 1, "a")]
    assert got["supporting"] == [(1, 1, "b")]
    assert sorted(got["late_fusion"]) == [(1, 1, "b"), (3, 1, "a")] and got["guarded"] == [(1, 1, "b")]


def test_routes_of_nulls(spark):
    none = spark.createDataFrame([(1, None, None, None, None, None, None)], "task_id long, symbol_hits long, regex_hits long, graph_hits long, identifier_density double, proper_names double, api_config double")
    assert policies.graph_admission(none).collect() == [(1, "abstain", "no_anchor")]
    assert policies.route_by_bucket(spark.createDataFrame([(1, None, None)], "task_id long, tags array<string>, has_candidates boolean")).collect() == [(1, "candidate_baseline")]


def test_contribution(spark):
    rows = [("b", 1, 1, "f", 1, 10), ("x", 1, 1, "f", 5, 14), ("x", 1, 2, "f", 12, 16), ("x", 1, 3, "g", 1, 2), ("y", 1, 1, "f", 2, 3), ("x", 2, 1, "f", 1, 1)]
    p = spark.createDataFrame(rows, "strategy string, task_id long, rank long, path string, start_line long, end_line long")
    gold = spark.createDataFrame([(1, "f", 9, 12)], "task_id long, path string, start_line long, end_line long")
    got = {r["strategy"]: tuple(r)[1:] for r in metrics.span_contribution(p, gold, "b").collect()}
    assert got == {"x": (2, 6, 1, 1, True), "y": (0, 0, 0, 0, False)}


def test_greedy_terms(spark):
    rows = [
        (1, "src/load.rs", 1, 5, 2, 1, 1.0, ["bm25", "rrf"]), (1, "src/load.rs", 8, 9, 2, 2, 0.9, ["bm25", "rrf"]), (1, "tests/load.rs", 1, 5, 1, 3, 0.8, ["regex"]),
        (1, "lib/other.rs", 1, 5, 1, 3, 0.8, ["regex"]), (1, "lib/load.rs", 1, 5, 1, 4, None, ["new"]),
    ]
    c = spark.createDataFrame(rows, packing.CANDIDATES + ", methods array<string>")
    q = spark.createDataFrame([(1, "load it"), (2, None)], "task_id long, query string")
    got = [(r.path, r.start_line) for r in packing.greedy_diversity(c, 9, q).orderBy("place").collect()]
    # After the first: lib/other .06 + .16 + .2, the rest of src/load .19 + .18 + .05 - .15, lib/load .05 + .05 + .2, tests/load .06 + .16 + .05 + .2 - .25.
    assert got[0] == ("src/load.rs", 1) and got[1] == ("lib/other.rs", 1) and got[2] == ("src/load.rs", 8)
