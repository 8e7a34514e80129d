"""Best hits of many queries: equal to brute force, and without shuffled words."""

import math
import re
from collections import Counter

from spanloom.operators import besthits, lexical
from spanloom.sources import corpus

LINES = ["the cat sat on the mat", "a dog and a cat", "mat of straw", "nothing here", "dog dog dog cat"]


def files_of(spark, texts):
    rows = [(f"f{i:04d}", "r", "unknown", f"sha{i}", len(t), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, repo_id string, language string, content_sha string, size long, content string")


def shuffled(spark) -> int:
    """Records that the session's stages have written to shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def brute(texts, queries, k):
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    mean, out = sum(map(len, docs)) / len(docs), {}
    for q, query in queries:
        scored = []
        for i, words in enumerate(docs):
            tf, score = Counter(words), 0.0
            for w in re.findall(r"\w+", query.lower()):
                df = sum(w in d for d in docs)
                if tf[w]:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if score:
                scored.append((-round(score, 6), f"f{i:04d}"))
        out[q] = [(p, -s) for s, p in sorted(scored)[:k]]
    return out


def test_bm25_is_brute_force_over_copies_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(besthits, "PIECE_WORDS", 100)
    texts = LINES * 30
    queries = [(q, f"{LINES[q % 5]} {LINES[q % 3]} zebra") for q in range(300)] + [(300, "zebra"), (301, "")]
    found = lexical.bm25(corpus.line_chunks(files_of(spark, texts)), spark.createDataFrame(queries, "query_id long, query string"), 7).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.path, r.score))
    wanted = {q: hits for q, hits in brute(texts, queries, 7).items() if hits}
    assert {q: [p for p, _ in hits] for q, hits in got.items()} == {q: [p for p, _ in hits] for q, hits in wanted.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in wanted for a, b in zip(got[q], wanted[q], strict=True))


def test_bm25_shuffles_neither_words_nor_pairs(spark):
    words = [f"w{i}" for i in range(40)]
    chunks = corpus.line_chunks(files_of(spark, [" ".join(words)] * 500))
    queries = spark.createDataFrame([(i, " ".join(words)) for i in range(3)], "query_id long, query string")
    before = shuffled(spark)
    assert lexical.bm25(chunks, queries, 2).count() == 6
    assert shuffled(spark) - before < 500 * 40 / 4


def test_overlap_of_words_and_whole_queries_without_pairs(spark):
    texts = ["load the zebra", "reload the zebras", "zebra the load", None, ""] * 200
    queries = spark.createDataFrame([(1, "load the zebra"), (2, "the load"), (3, ""), (4, None), (5, "quagga"), (6, "- -")], "query_id long, query string")
    before = shuffled(spark)
    files = spark.createDataFrame([(f"f{i:04d}", t) for i, t in enumerate(texts)], "path string, content string")
    got = {(r.query_id, r.rank): (r.path, r.score) for r in lexical.symbol_overlap(files, queries, 2).collect()}
    assert got == {(1, 1): ("f0000", 6.0), (1, 2): ("f0005", 6.0), (2, 1): ("f0002", 5.0), (2, 2): ("f0007", 5.0)}
    assert shuffled(spark) - before < 400
