"""Nulls, empty and very long texts, repeated rows, empty tables and clashing
column names: every operator and stage gives its defined result."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import decontam, langid, pieces, quality, secrets, simhash, tokenpack, toxicity, warc

CLASHES = ["h", "v", "span", "key", "fp", "draw", "seed", "owner", "repo", "rid", "ids", "score", "item_id", "base", "hash", "_text", "root", "start"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHES)
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box many lively jars"
LONG = "lorem ipsum dolor sit amet password = hunter2hunter2 " * 20_000
TEXTS = [
    (1, "A plain text, with some words in it."),
    (1, "A plain text, with some words in it."),
    (2, None), (3, ""), (None, "token: abcdef123"), (None, None), (4, " \n\t "),
    (5, LONG), (6, f"before {ITEM} after"), (7, "AKIA" + "ABCDEFGH12345678"), (8, "\U0001f600 café 中文 deadbeefdeadbeefdeadbeef"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", None, *["x"] * len(CLASHES)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM, "x"), (2, ITEM, "x"), (3, None, "x"), (4, "", "x"), (5, "two words", "x"), (None, None, "x")]
    return spark.createDataFrame(rows, "item_id long, text string, seed string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(TEXTS)
    return out


def test_secrets(docs, empty):
    got = by_id(secrets.secret_report(docs))
    assert got[5][0]["n_assign"] == 20_000 and got[7][0]["n_access"] == 1 and got[8][0]["n_hex"] == 1
    assert got[8][0]["spans"] == "hex:10:34"
    assert {r["base_sha256"] for r in got[2] + got[3] + got[4]} == {hashlib.sha256(b"").hexdigest()}
    assert sorted(r["n_assign"] for r in got[None]) == [0, 1]
    assert secrets.secret_report(empty).count() == 0
    masked = {r["doc_id"]: r for r in secrets.masked_documents(docs).where("doc_id is not null").collect()}
    assert masked[5]["text"].count("[REDACTED]") == 20_000 and "hunter2" not in masked[5]["text"]
    assert masked[2]["text"] is None and masked[1]["text"] == TEXTS[0][1]
    assert secrets.masked_documents(docs).count() == len(TEXTS) and secrets.masked_documents(docs).columns == docs.columns


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicate_report(docs))
    assert {r["fingerprint"] for r in got[2] + got[3] + got[4]} == {"0" * 16}
    assert {r["component_id"] for r in got[2] + got[3] + got[4]} == {2} and len(got[1]) == 2
    assert simhash.near_duplicate_report(empty).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0


def test_language(docs, empty):
    got = by_id(langid.language_report(docs))
    assert {(r["lang_pred"], r["score"]) for r in got[2] + got[3] + got[4]} == {("und", 1.0)}
    assert not any(r["held_out"] for r in got[None])
    assert langid.language_report(empty).count() == 0
    assert langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_decontamination(docs, empty, items):
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contamination_report(docs, items).collect()]
    assert got == [(6, 1)]
    assert decontam.contamination_report(empty, items).count() == 0 and decontam.contamination_report(docs, items.limit(0)).count() == 0
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1


def test_warc(spark):
    big = "x" * 200
    rows = [(1, "http://a", big, "c"), (2, "http://b", big, "c"), (2, "http://b", big, "c"), (3, None, None, "c"), (4, "u v", "", "c"), (None, "n", big, "c"), (5, "l", "é" * 2_000_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.warc_report(spark, pages).collect()), key=repr)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), digest(h), "revisit" if h == big and i != 1 else "response", 1 if h == big and i != 1 else None) for i, _, h, _ in rows]
    assert got == sorted(want, key=repr)
    assert warc.warc_report(spark, pages.limit(0)).count() == 0


def test_toxicity(docs, empty, labels):
    got = by_id(toxicity.toxicity_report(docs, labels))
    assert len({r["score"] for r in got[2] + got[3]}) == 1 and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert toxicity.toxicity_report(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0.0}


def test_packed_ids(spark, docs, empty):
    got = by_id(tokenpack.packed_report(spark, docs))
    assert {r["n_tokens"] for r in got[2] + got[3] + got[4]} == {1}
    rows = sorted((r["start"], r["n_tokens"]) for rs in got.values() for r in rs)
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))
    assert tokenpack.packed_report(spark, empty).count() == 0


def test_pieces(docs, empty):
    got = by_id(pieces.encoding_report(docs))
    assert all(r["round_trip"] for rs in got.values() for r in rs) and {r["n_ids"] for r in got[2] + got[3]} == {0}
    counts = by_id(pieces.count_report(docs))
    assert {k: sorted(r["n_tokens"] for r in v) for k, v in counts.items()} == {k: sorted(r["n_ids"] for r in v) for k, v in got.items()}
    assert pieces.encoding_report(empty).count() == 0 and pieces.count_report(empty).count() == 0


def test_quality(docs, empty):
    got = by_id(quality.quality_report(docs))
    assert all(r["base_failed"] and not r["kept"] for r in got[2] + got[3] + got[1])
    assert got[5][0]["n_repeat_words"] == got[5][0]["n_words"] and quality.quality_report(empty).count() == 0


def test_every_stage(spark, docs, empty, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, str(tmp_path))
            assert out.count() <= given.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == given.columns


def test_parts_of_a_batch_are_bounded_by_rows_and_bytes(monkeypatch):
    texts = [None, "", "ab", "x" * 50, "cd", None, "é" * 4, "y" * 9, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], ["doc_id", "text"])
    monkeypatch.setattr(pieces, "PART_ROWS", 4)
    monkeypatch.setattr(pieces, "PART_BYTES", 10)
    runs = [p.column("text").to_pylist() for p in pieces._parts(batch, "text")]
    assert [t for run in runs for t in run] == texts
    for run in runs:
        assert len(run) <= 4 and (len(run) == 1 or sum(len((t or "").encode()) for t in run) <= 10)
    assert runs[1] == ["x" * 50]
    assert list(pieces._parts(batch.slice(0, 0), "text")) == []
    assert [p.column("text").to_pylist() for p in pieces._parts(batch.slice(3, 2), "text")] == [["x" * 50], ["cd"]]
