"""Steps whose cost must grow no faster than their input."""

import hashlib

import numpy as np
from pyspark.sql import functions as F
from test_besthits import shuffled

from spanloom.operators import manypatterns, packing, vectors


def test_policies_deal_rows_by_task_once(spark):
    rows = [(s, t, r, f"d/{(t + r) % 9}", r, r + 4, 1.0 / r) for s in ("bm25", "rrf", "regex") for t in range(50) for r in range(1, 6)]
    found = spark.createDataFrame(rows, "strategy string, task_id long, rank long, path string, start_line long, end_line long, score double")
    for policy in (lambda c: packing.budgeted_acquisition(c, 5), lambda c: packing.greedy_diversity(c, 5), lambda c: packing.anchored(c, 5), packing.contrast_pack):
        before = shuffled(spark)
        got = policy(packing.agreed_candidates(found)).collect()
        assert len({r.task_id for r in got}) == 50 and len(got) >= 250 - 50
        assert shuffled(spark) - before <= 1.2 * len(rows)


def test_mock_embedding_hashes_a_text_once(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "ü" * 3000)], "doc_id long, text string")
    got = vectors.mock_embedding(texts, "doc_id", 8)
    # A hash of the text inside the loop over dimensions is made once a dimension.
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
    for key, text in ((1, "a b"), (2, ""), (3, "ü" * 3000)):
        whole = hashlib.sha256(text.encode()).hexdigest()
        x = np.array([int(hashlib.sha256(f"{whole}:{i}".encode()).hexdigest()[:8], 16) - 2.0**31 for i in range(8)])
        assert np.allclose(got.where(f"doc_id = {key}").first().embedding, x / np.linalg.norm(x), atol=1e-12)


def test_quantized_search_makes_no_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=70 if i % 9 == 4 else 64)]) for i in range(600)] + [(600, None), (601, [0.0] * 64)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    codes = {r.vec_id: r for r in vectors.quantize(table.where("size(embedding) = 64")).collect()}
    coded = spark.createDataFrame(list(codes.values()), "vec_id long, sign_bits array<bigint>, mag_bits array<bigint>").cache()

    def distance(a, b):
        pairs = (2, a.sign_bits[0], b.sign_bits[0]), (1, a.mag_bits[0], b.mag_bits[0])
        return sum(f * ((x ^ y) & (2**64 - 1)).bit_count() for f, x, y in pairs)

    asked = [v for v in codes if v % 20 == 0]
    near = {q: sorted((distance(codes[q], codes[v]), v) for v in codes if v != q) for q in asked}
    before = shuffled(spark)
    got = vectors.quantized_topk(coded, coded.where("vec_id % 20 = 0"), 3).collect()
    assert sorted((r.query_id, r.rank, r.distance, r.vec_id) for r in got) == sorted((q, i + 1, *hit) for q in asked for i, hit in enumerate(near[q][:3]))
    unit = {v: np.array(e, np.float32).astype(float) for v, e in rows if v in codes}
    cosine = lambda a, b: round(float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0), 6)
    best = {q: sorted((-cosine(unit[q], unit[v]), v) for _, v in near[q][:150])[:5] for q in asked}
    vectors.PART_ROWS, was = 100, vectors.PART_ROWS
    try:
        found = vectors.quantized_rerank(table, coded, F.col("vec_id") % 20 == 0, 150, 5).collect()
    finally:
        vectors.PART_ROWS = was
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == sorted((q, i + 1, v) for q in asked for i, (_, v) in enumerate(best[q]))
    # The pool's pairs alone would be 150 a query.
    assert shuffled(spark) - before < 100 * len(asked) + 4 * len(rows)


def test_stems_of_names_with_line_feeds(spark):
    rows = [("r", "notes/1.txt", "a test of One.\nTwo here"), ("r", "notes/2.txt", "a test of One.\nTwo.py"), ("r", "lib/One.\nTwo.py", ""), ("r", "lib/x.py\n", "")]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    got = {(r.source_path, r.target_path) for r in manypatterns.stem_tests(files, "contains(content, 'test')", "startswith(path, 'lib/O')").collect()}
    assert got == {("notes/1.txt", "lib/One.\nTwo.py"), ("notes/2.txt", "lib/One.\nTwo.py")}


def test_difference_packs_parts_hold_few_items(spark, monkeypatch):
    """parts were as large as their bytes allowed, with seven orders of
    each in memory; more items now make more parts."""
    monkeypatch.setattr(packing, "ITEMS_A_TASK", 100)

    def parts(n):
        items = spark.range(n).selectExpr("'s' AS strategy", "id AS task_id", "1L AS rank", "concat('p', id) AS path")
        got = packing.difference_aware(items, items.where("task_id % 3 = 0").select("strategy", "task_id", "path"))
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 8 * n
        return len(sizes), max(sizes)

    few, many = parts(1000), parts(4000)
    assert many[0] > 3 * few[0] and many[1] < 1.5 * few[1] and many[1] < 8 * 200
