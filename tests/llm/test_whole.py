"""Cases that earlier forms of the corpus operators lost."""

import io
import random
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from spanloom.llm import decontam, langid, pieces, quality, secrets, simhash, tokenpack, toxicity, warc


def test_toxicity_pools_the_forms_of_a_word():
    """Held out over sf0.1. Other languages' toxic texts share stems, not words."""
    d = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["toxic"] is not None}
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    known = sorted((r["doc_id"], r["text"]) for r in docs if r["doc_id"] in label)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in known]
    fit = [(toxicity.lowered(t), label[i]) for (i, t), h in zip(known, held) if not h]
    labels = [y for _, y in fit]
    model = toxicity.ToxicityModel([t for t, _ in fit], labels, {v: labels.count(v) for v in (0, 1)})
    scores = [(label[i], model.score(t)) for (i, t), h in zip(known, held) if h]
    bad, good = ([s >= 0.5 for y, s in scores if y == v] for v in (1, 0))
    assert sum(bad) > 0.7 * len(bad) and sum(good) < 0.02 * len(good)


def test_an_id_on_two_texts_loses_neither(spark):
    a = " ".join(f"alpha{i} beta{i * 7}" for i in range(60))
    b = " ".join(f"gamma{i} delta{i * 5}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, b.upper())], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect())) == sorted([(1, a), (1, b)])
    alone = spark.createDataFrame([(1, a), (1, b), (0, a.upper())], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one_of_each(alone).collect())) == sorted([(0, a.upper()), (1, b)])


@pytest.mark.parametrize("part", [" ", "中文字符测试", "aZ3/", "x", "▁"])
def test_a_megabyte_in_one_word(part):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    text = part * (1_000_000 // len(part))
    start = time.perf_counter()
    ids = own.encode([text])[0]
    assert own.decode_all([ids]) == [text.replace("▁", " ")] and own.count([text]) == [len(ids) // 4]
    assert time.perf_counter() - start < 60
    some = text[:20_000]
    assert np.frombuffer(own.encode([some])[0], "<u4").tolist() == library.encode(some)


def test_a_record_is_read_at_its_offset():
    records = [warc.info("x.warc.zst", "2020-01-01T00:00:00Z")]
    records += [warc.record(i, "http://x/", f"<p>{i}</p>".encode() * 90, "0" * 64, 3, "2020-01-01T00:00:00Z", i, 3) for i in range(50)]
    out, places = io.BytesIO(), []
    warc.write_archive(iter(records), out, places)
    assert [warc.read_at(out, at) for at in places[::7]] == records[::7]
    assert warc.parse(records[0]) is None and warc.parse(records[5])[0] == 4


def test_repeated_pages_have_records_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string")
    rows = [r["row"] for r in warc.decided(pages).collect()]
    assert len(set(rows)) == 3
    read = warc.warc_report(spark, pages)
    assert sorted(r["record_type"] for r in read.collect()) == ["response", "response", "revisit"]
    assert warc.dangling_revisits(read).count() == 0
    assert warc.dangling_revisits(read.where("record_type = 'revisit'")).count() == 1


def test_many_secrets_in_one_text(spark):
    def seconds(n):
        text = " é ".join(f"deadbeefdeadbeefdeadbeef{i:08x} password=hunter{i:05d} Ab3{i:05d}cdefghijklmnopqr" for i in range(n))
        docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
        start = time.perf_counter()
        (row,) = secrets.masked_documents(docs).collect()
        assert row["text"].split(" é ") == ["[REDACTED] [REDACTED] [REDACTED]"] * n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(12_000) < 45


def test_a_repository_of_two_owners_counts_once(spark):
    found = spark.createDataFrame([("v", "a", "r"), ("v", "b", "r"), ("v", None, "r"), ("w", "a", None)], "v string, owner string, repo string")
    assert sorted(map(tuple, secrets.ownership(found).collect())) == [("v", 2, 1), ("w", 1, 0)]


def test_generic_spans_apart_from_base_ones(spark):
    rng = random.Random(2)
    for _ in range(3):
        base = sorted((a, 0, a + rng.randint(1, 30)) for a in rng.sample(range(4000), 200))
        extra = sorted((a, 3, a + rng.randint(1, 9)) for a in rng.sample(range(4000), 300))
        df = spark.createDataFrame([(base, extra)], "base array<struct<s:int,k:int,e:int>>, extra array<struct<s:int,k:int,e:int>>")
        got = [tuple(x) for x in df.select(secrets._apart(df.base, df.extra)).first()[0]]
        assert got == [x for x in extra if all(x[2] <= b[0] or b[2] <= x[0] for b in base)]


def test_every_label_is_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{(letters[i % 80 % 26] + letters[i % 80 // 26] + 'x') * 3} " * 12, f"l{i % 80:02d}") for i in range(800)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 80


def test_the_language_sample_is_bounded_and_counts_a_text_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(langid, "LanguageModel", lambda x, langs: made.append(langs))
    rows = [(i, f"words of text {i} here", "en" if i % 2 else "de") for i in range(3000)] + [(4, "the same text again", "de")] * 2000
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert sorted({v: made[0].count(v) for v in made[0]}.items()) == [("de", 100), ("en", 100)]


def test_digits_that_are_no_letters():
    model = langid.LanguageModel(np.zeros((0, langid.DIMENSIONS), np.float32), [])
    assert model.predict("² ½ 12") == ("und", 1.0) and model.predict("a") == ("und", 0.0)


def test_features_do_not_depend_on_the_block(monkeypatch):
    text = "Été à Paris, words 12 and more " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "STEP", 7)
    assert (langid.features(text) == whole).all()


def test_capitals_are_letters():
    assert quality.measure("ⒶⒷⒸ ⅧⅨ AÉb")[6:8] == (2, 3)


ALPHABET = [f"w{i}" for i in range(40)]


def brute_overlaps(docs, items):
    out = {}
    for d, text in docs:
        a = text.split()
        for i, item in items:
            b = item.split()
            w = min(13, len(b))
            for x in range(len(a) - w + 1):
                for y in range(len(b) - w + 1):
                    n = sum(p == q for p, q in zip(a[x : x + w], b[y : y + w]))
                    if n >= w - w * 2 // 13:
                        m, lo, hi = out.get((d, i), (0, x, 0))
                        out[d, i] = (max(m, n), min(lo, x), max(hi, x + w - 1))
    return out


def test_every_alignment_by_brute_force(spark):
    rng = random.Random(9)
    words = lambda n, k=40: [rng.choice(ALPHABET[:k]) for _ in range(n)]
    items = [words(n) for n in (1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 12, 13, 13, 14, 20, 40)] + [words(30, 2)]
    docs = []
    for k in range(160):
        piece = list(items[k % len(items)])
        for _ in range(rng.randint(0, 3)):
            piece[rng.randrange(len(piece))] = "zz"
        docs.append(words(rng.randint(0, 20)) + piece + words(rng.randint(0, 20)))
    docs.append(words(60, 2))
    docs = [(k, " ".join(t)) for k, t in enumerate(docs)]
    items = [(k, " ".join(t)) for k, t in enumerate(items)]
    got = decontam.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["first_word"], r["last_word"]) for r in got.collect()}
    assert got == brute_overlaps(docs, items)


def test_masks_meet_every_placing_in_every_class():
    for n in range(1, 13):
        t = decontam.tolerance(n)
        for gone in combinations(range(n), t):
            assert any(all(at + o not in gone for o in m) for m in decontam.masks_of(n) for at in range(n - m[-1]))


@pytest.mark.parametrize("slices", [1, 3])
def test_slices_and_joins_beyond_the_bounds(spark, monkeypatch, slices):
    """Beyond every size check the results stay the same."""
    docs = [(1, " ".join(ALPHABET[:30]), "s"), (2, "clean text", "s"), (3, " ".join(ALPHABET[8:40]), "t"), (3, "token = abcdef99", "u"), (3, "token = abcdef99", "u")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    items = spark.createDataFrame([(7, " ".join(ALPHABET[5:25]))], "item_id long, text string")
    monkeypatch.setattr(decontam, "SLICE_SEEDS", 60 // slices)
    monkeypatch.setattr(decontam, "SLICE_WORDS", 0)
    monkeypatch.setattr(secrets, "MARKED", 0)
    for module in (decontam, simhash):
        monkeypatch.setattr(module, "few", lambda df: df)
    assert sorted((r["doc_id"], r["matched"]) for r in decontam.contamination_report(docs, items).collect()) == [(1, 13), (3, 13)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()) == [2, 3, 3]
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == [1, 2, 3, 3]
    assert sorted((r["doc_id"], "[REDACTED]" in r["text"]) for r in secrets.masked_documents(docs).collect()) == [(1, False), (2, False), (3, False), (3, True), (3, True)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["_spans", "_masked", "_text_hash", "hash", "row", "mine", "id", "h", "spans", "bad_id", "bad_hash", "changed", "new", "lead", "root", "rid"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "some words, token: abcdef99", "en", "s", 1, *names), (2, "some words, token: abcdef99", "en", "s", 1, *names), (3, "other things here", "en", "s", 1, *names)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == names


def test_of_rows_that_repeat_a_leader_one_stays_whatever_the_order(spark):
    rows = [(1, "the same text", f"s{k}") for k in range(6)]
    kept = {simhash.keep_one_of_each(spark.createDataFrame(part, "doc_id long, text string, source string").repartition(n)).first()["source"] for part, n in ((rows, 1), (rows[::-1], 3))}
    assert len(kept) == 1


def test_hot_buckets_are_split_and_lose_no_link(spark):
    rng = random.Random(4)
    head = rng.getrandbits(26)
    values = sorted({(rng.getrandbits(38) << 26 | head) for _ in range(150)} | {0})
    values = sorted({v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for v in values for _ in range(3)} | set(values))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), chunk=8)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    group = lambda of: sorted(sorted(v for v in values if of(v) == r) for r in {of(v) for v in values})
    assert group(lambda v: roots.get(signed(v), signed(v))) == group(find)


def test_caches_are_bounded_by_size(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = tokenpack.WordEncoder(path, kept=10_000)
    for k in range(300):
        words.encode(f"word{k} {'x' * 500}{k}".encode())
        assert words.size_now <= 20_000 and len(words.before) < 200


def test_the_toxic_text_of_a_repeated_id_is_the_same_in_any_order(spark):
    rows = [(1, "one text"), (1, "another text"), (2, "plain words")]
    made = []
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame(part, "doc_id long, text string").repartition(len(made) + 1)
        labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0)], "doc_id long, toxic int")
        made.append(toxicity.train(docs, labels).score("one text"))
    assert made[0] == made[1]
