"""Cases that earlier forms of the engine's queries lost."""

from spanloom.operators import governance, policies, stats, vectors
from spanloom.plans import context
from spanloom.plans.catalog import QUERIES


def test_composed_plans_ask_with_the_whole_item(spark, tmp_path):
    rows = [(7, "function load_zebra zebraquark", "typescript", "s", 1), (8, "import x from './7'", "typescript", "s", 1), (9, "other words", "typescript", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    item = "one two three four five six zebraquark load_zebra"
    spark.createDataFrame([(1, item), (2, "load_zebra")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    fused = QUERIES["retrieve_fused"](spark, str(tmp_path)).collect()
    assert [r["path"] for r in fused if r["query_id"] == 1 and "bm25" in r["channels"]] == ["doc/7"]
    got = {(r["query_id"], r["path"]): r["channels"] for r in QUERIES["fast_context"](spark, str(tmp_path)).collect()}
    # A name is searched for as the whole query, so only the second item defines one.
    assert got[1, "doc/7"] == "bm25" and "symbol" in got[2, "doc/7"] and "regex" in got[2, "doc/7"] and got[1, "doc/8"] == "graph"


def test_bootstraps_draw_as_often_as_the_reference(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(stats, "bootstrap_interval", lambda *a, resamples=1000, **k: asked.append(resamples))
    QUERIES["bootstrap_ci"](spark, sf), QUERIES["paired_bootstrap"](spark, sf)
    assert asked[0] >= 10_000 and asked[1] >= 1000


def test_codes_of_more_than_64_dimensions_differ(spark):
    rows = [(1, [1.0] * 80), (2, [1.0] * 64 + [-1.0] * 16), (3, [0.5] * 3), (4, None)]
    codes = vectors.quantize(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"))
    got = vectors.quantized_topk(codes, codes.where("vec_id = 1"), 5).collect()
    assert [(r["vec_id"], r["distance"]) for r in got] == [(2, 32)]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = every.selectExpr("vec_id as query_id", "embedding")
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in vectors.cosine_topk(every, asked, 5).collect()}
    assert len(score) == 12 and score[1, 2] == 0.6 and score[1, 3] == score[4, 1] == score[3, 4] == 0


def test_candidates_of_two_bit_codes_reach_the_recall(spark):
    got = [r["overlap"] for r in QUERIES["quantized_overlap_at_10"](spark, "/root/testdata/sf0.1").collect()]
    assert sum(got) / len(got) >= 0.9


def test_short_and_cut_passages_are_found(spark):
    text = "one two three four five six seven eight nine ten eleven"
    corpus = spark.createDataFrame([("a", text), ("b", "nothing"), ("c", None)], "path string, content string")
    items = ["three four five", "wo three four five si", "two three", "x", "eve", text, "four six", None]
    passages = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {r["item_id"] for r in governance.passage_leaks(corpus, passages).where("path = 'a'").collect()}
    assert got == {i for i, t in enumerate(items) if t is not None and t in text}


def test_admission_by_hand(spark):
    base = dict.fromkeys("exact_unique unique symbol regex local rrf_backed span_narrow within dense_support graph_support agree_file agree_span rrf_file rrf_span".split(), False)
    cases = [
        ({"bucket": "hard_distractor", "symbol": True, "regex": True, "local": True}, "filter", "filter"),
        ({"bucket": "hard_distractor", "graph_support": True}, "supporting", "supporting"),
        ({"bucket": "config", "span_narrow": True}, "abstain", "abstain"),
        ({"bucket": "config", "span_narrow": True, "within": True}, "narrow", "abstain"),
        ({"bucket": "route_handler", "symbol": True, "regex": True, "local": True, "agree_file": True}, "union", "weak"),
        ({"bucket": "config", "rrf_backed": True, "local": True, "rrf_file": True, "rrf_span": True}, "rrf", "rrf"),
        ({"bucket": "other", "tags": ["weak_candidates"], "local": True}, "weak", "weak"),
        ({"bucket": "negative", "tags": ["negative"]}, "abstain", "filter"),
        ({"bucket": "ambiguous", "agree_span": True, "noise": 0.1}, "filter", "weak"),
        ({"bucket": "other", "dense_support": True}, "weak", "supporting"),
    ]
    rows = [{**base, "noise": 0.0, "tags": [], "bucket": "other", **c, "id": i} for i, (c, _, _) in enumerate(cases)]
    schema = "id int, bucket string, noise double, tags array<string>, " + ", ".join(f"{b} boolean" for b in base)
    order = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)
    for at, version in ((1, "v3"), (2, "h2")):
        got = [r["action"] for r in policies.admission(df, version).orderBy("id").collect()]
        assert got == [c[at] for c in cases], version
    points = {r["id"]: r["points"] for r in policies.admission(df).collect()}
    assert points[4] == 4 and points[7] == -5


def test_channels_on_their_own(spark):
    rows = [("a.py", "def load_zebra():\n  return 1\n"), ("b.py", "import a\nfrom a import load_zebra\n"), ("c.py", "zebra load def\n")]
    files = spark.createDataFrame(rows, "path string, content string").selectExpr(
        "path", "'python' AS language", "sha2(content, 256) AS content_sha", "content", "cast(length(content) as long) AS size")
    asked = spark.createDataFrame([(1, "load_zebra")], "query_id long, query string")
    for channel in context.CHANNELS:
        got = context.channel_hits(files, asked, (channel,), 5)
        named = {"text": {"regex"}, "graph": {"graph", "regex"}}.get(channel, {channel})
        assert {r["channel"] for r in got.collect()} <= named
    hits = lambda channel: {r["path"] for r in context.channel_hits(files, asked, (channel,), 5).collect()}
    assert hits("regex") >= {"a.py", "b.py"} and hits("text") == {"a.py", "b.py"}


def test_h2_takes_tags_in_any_case(spark):
    names = sorted({w for group in policies.ADMISSION_POINTS["h2"] for c, _ in group for w in c.split() if w.isidentifier() and w.islower()} - {"noise", "bucket", "positive"})
    flags = {n: False for n in ("exact_unique", "symbol", "regex", "local", "rrf_backed", "span_narrow", "within", "agree_file", "agree_span", "rrf_file", "rrf_span", "dense_support", "graph_support", *names)}
    rows = [(i, 0.0, "other", tags, *flags.values()) for i, tags in enumerate((["Negative"], ["negative"], ["neutral"], [None], None))]
    schema = "task_id int, noise double, bucket string, tags array<string>, " + ", ".join(f"{n} boolean" for n in flags)
    got = {r["task_id"]: (r["points"], r["action"], r["tags"]) for r in policies.admission(spark.createDataFrame(rows, schema), "h2").collect()}
    assert got[0] == (-3, "filter", ["Negative"]) and got[1][:2] == (-3, "filter")
    assert got[2][:2] == got[3][:2] == got[4][:2] == (0, "abstain")


def test_vectors_without_id_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.cosine_topk(v, v.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(1, 2), (2, 1)]


def test_bootstrap_means_do_not_depend_on_order(spark):
    rows = [(i % 3, i, (i * 7919 % 1000) / 997 - 0.3) for i in range(3000)]
    rows += [(0, 5000, float("nan")), (1, 5001, None), (2, 5002, float("inf"))]
    df = spark.createDataFrame(rows, "g int, key int, v double")
    a, b = (sorted(map(tuple, stats.bootstrap_means(df.repartition(n, "v"), "v", "key", ["g"], 50).collect())) for n in (3, 7))
    assert a == b and len(a) == 150
    mean = sum(v for g, _, v in rows[:3000] if g == 0) / 1000
    assert abs(sum(m for g, _, m in a if g == 0) / 50 - mean) < 0.03


def test_vectors_of_one_space(spark, tmp_path):
    rows = [(1, "a", "m", 2), (2, "a", "m", 3), (3, "a", "other", 2), (4, "b", "m", 2), (5, None, "m", 2), (6, "a", "m", None), (7, "a", "m", 2)]
    spark.createDataFrame(rows, "vec_id long, provider_id string, model_id string, dimensions int").write.parquet(f"{tmp_path}/v")
    got = vectors.of_space(spark.read.parquet(f"{tmp_path}/v"), {"provider_id": "a", "model_id": "m", "dimensions": 2})
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 7]
    # The plain plan shortens its metadata; this form has all pushed filters.
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert all(f"EqualTo({c}," in plan for c in vectors.SPACE)
