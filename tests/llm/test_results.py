"""Results against SQL, brute force, the libraries, and held-out labels."""

import io
import random
import struct
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import decontam, langid, pieces, quality, secrets, simhash, tokenpack, warc
from spanloom.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    place = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(place) == columns
    want = sorted(repr(tuple(r[place[c]] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def plain_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_simhash_components(spark, sf, texts):
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = {d: (f"{prints[d]:016x}", c) for d, c in plain_components(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash_near_dedup"](spark, sf).collect()} == want


def test_simhash_chunks_lose_no_link(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(20)})
    classes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.fingerprint_links(classes, chunk=3)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = {v: roots.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v) for v in values}
    want = plain_components(dict(zip(values, values)))
    group = lambda of: sorted(sorted(v for v in values if of[v] == r) for r in set(of.values()))
    assert group(got) == group(want)


def test_bit_planes_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ rng.choice(a ^ a[::-1], 300) * (rng.random(300) < 0.5)
    near = np.unpackbits(simhash.near_lanes(simhash.bit_planes(a), simhash.bit_planes(b), simhash.lanes_after(300)).view(np.uint8), bitorder="little")[:300]
    assert near.tolist() == [int((int(x) ^ int(y)).bit_count() <= 3) for x, y in zip(a, b)]


def test_language_held_out(spark, sf):
    got = QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_pairs_vote():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 16)).astype(np.float32) * 0.05
    langs = ["es", "pt", "de"] * 30
    for i, lang in enumerate(langs):
        x[i, {"es": 0, "pt": 1, "de": 2}[lang]] += 1
    model = langid.LanguageModel(x, langs)
    assert model.members == {"germanic": ["de"], "romance": ["es", "pt"]} and list(model.pairs["romance"][0]) == [("es", "pt")]


@pytest.fixture(scope="module")
def toxicity_scores(spark, sf):
    """Held-out scores by label over sf0.1: the smaller tables hold out six
    toxic texts at most. A third of the toxic labels has no telling word."""
    d = sf.replace("0.001", "0.1")
    got = QUERIES["op6_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = got.where("held_out and toxic is not null").collect()
    return [[r["score"] for r in rows if r["toxic"] == v] for v in (1, 0)]


def test_toxicity_held_out(toxicity_scores):
    bad, good = toxicity_scores
    assert len(bad) > 50 and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) > 0.9
    assert sum(g >= 0.5 for g in good) < 0.02 * len(good)


def test_toxicity_recall_goal(toxicity_scores):
    bad, _ = toxicity_scores
    assert sum(b >= 0.5 for b in bad) > 0.6 * len(bad)


def test_masks_meet_every_placing_of_two_substitutions():
    for gone in combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(all(at + o not in gone for o in m) for m in decontam.MASKS for at in range(decontam.WINDOW - m[-1]))


def test_substitutions_are_found(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    benchmark = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    rows = []
    for k, gone in enumerate([(), (0,), (0, 12), (6, 7), (3, 9), (1, 5, 9)]):
        rows.append((k, "pre " + " ".join("zzz" if i in gone else w for i, w in enumerate(item)) + " post"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["matched"] for r in decontam.contamination_report(docs, benchmark).collect()} == {0: 13, 1: 12, 2: 11, 3: 11, 4: 11}


def test_owner_specific_secrets(spark):
    live, copied = "aB3dE5gH7jK9mN1pQ3sT", "zY9xW8vU7tS6rQ5pO4nM"
    rows = [(i, f"see {copied} here", f"owner{i}") for i in range(5)] + [(9, f"see {live} here", "owner9")]
    got = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[9]["spans"] == "generic:4:24" and got[9]["n_live"] == 1
    assert got[0]["spans"] == "" and got[0]["n_copied"] == 1


def test_archive_layout():
    records = [warc.record(i, f"http://x/{i}", f"<p>page {i} text</p>".encode() * 20, "0" * 64, 0 if i else None, "2020-01-01T00:00:00Z") for i in range(200)]
    out = io.BytesIO()
    assert warc.write_archive(iter(records), out) == 200
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    frame = opener.decompressobj()
    assert frame.decompress(data[8 + size :]) == records[0] and frame.unused_data
    assert list(warc.read_archive(io.BytesIO(data))) == records
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(data[:-5])))


def test_ids_equal_the_tokenizer(spark, sf, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for d in sorted(texts):
        ids = np.array([*whole.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_packed_ids"](spark, sf).collect()} == want


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "I'm DON'T İßẞ x́ é", "1234 a1b2", " x y\x1cz\x85", "naïveÉté,. ...", "<|ENDOFTEXT|> \U0001f600‍\U0001f525"])
def test_word_encoder(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenpack.WordEncoder(path).encode(text.encode()), "<u4").tolist() == want


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 32])
def test_packed_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 30_000, dtype=np.uint64).astype("<u4")
    out = io.BytesIO()
    writer, at = tokenpack.PackedWriter(out, bits), 0
    for k, n in enumerate([0, 1, 9_000, 8_191, 12_808]):
        writer.add(k, ids[at : at + n])
        at += n
    writer.close()
    reader = tokenpack.PackedReader(out, len(out.getvalue()))
    for a, b in [(0, 1), (5, 5), (8_190, 8_194), (100, 29_999), (29_999, 30_000), (0, 30_000)]:
        assert (reader.ids(a, b) == ids[a:b]).all()
    assert [d for d, _, _ in reader.documents(at_once=100)] == [0, 1, 2, 3, 4]


def test_pieces_equal_the_library(spark, sf, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: np.array(library.encode(t), "<u4") for d, t in texts.items()}
    got = QUERIES["op8_piece_encoding"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_ids"], r["ids_crc32"]) for r in got} == {d: (len(x), zlib.crc32(x.tobytes())) for d, x in want.items()}
    assert all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, sf).collect()} == {d: len(x) for d, x in want.items()}


@pytest.mark.parametrize("text", ["  two  blanks ", " ", "\n\n", "a\n b", "中文\U0001f600", "x" * 500, "aaaaaaab", "\t tab", "don't -- stop...", "▁ mark"])
def test_odd_pieces(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    ids = np.frombuffer(own.encode([text])[0], "<u4")
    assert ids.tolist() == library.encode(text) and own.count([text]) == [len(ids)]
    assert own.decode(ids) == text.replace("▁", " ")


def test_random_texts_against_the_library(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    rng = random.Random(5)
    letters = "".join(texts.values())
    made = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2_000)]
    want = library.encode(made)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(made)] == want
    assert own.count(made) == list(map(len, want))


def test_policies_and_ablations(spark, sf):
    ledger = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r["fail_bits"] for r in ledger.collect()]
    for policy, rules in quality.POLICIES.items():
        mask = quality.mask_of(rules)
        got = {r["rule"]: (r["n_failed"], r["n_only_this"], r["n_rejected"]) for r in quality.ablations(ledger, policy).collect()}
        one = lambda r: 1 << quality.RULES.index(r)
        assert got == {r: (sum(b & one(r) > 0 for b in bits), sum(b & mask == one(r) for b in bits), sum(b & mask > 0 for b in bits)) for r in rules}
        assert ledger.where(quality.passes(policy)).count() == sum(b & mask == 0 for b in bits)


def test_pipeline(spark, sf, texts):
    """Each document's way through the stages, decided one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    told = {d: model.predict(t) for d, t in texts.items()}
    left = {d: t for d, t in texts.items() if told[d][0] != "und" and told[d][1] >= 0.05}
    heads = plain_components({d: plain_fingerprint(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if heads[d] == d}
    bad = {r["doc_id"] for r in decontam.contamination_report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    left = {d: t for d, t in left.items() if d not in bad}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == set(left)
    whole = docs.where(docs.doc_id.isin(*left))
    masked = {r["doc_id"]: r["text"] for r in secrets.masked_documents(whole).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(np.frombuffer(out[d]["ids"], "<u4").tolist() == library.encode(masked[d] or "") for d in left)
