"""Exact search, phrase mining and the fill-in-the-middle transformation
against brute force, with their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import decontam, exactsearch, middle, phrases

LONG = "doc_id long, text string"


# ---------------------------------------------------------------------- search
def brute_topk(rows, step, k, scale=64):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % step == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
        clip = lambda s: max(exactsearch.LOW, min(exactsearch.HIGH, s))
        scored = sorted((-clip(-s), i) for s, i in scored)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def searched(spark, rows, kind="double", k=20, parts=3):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, query_id string, v int").repartition(parts)
    from pyspark.sql import functions as F

    got = exactsearch.exact_topk(df, F.col("vec_id") % 20 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def with_extras(rows):
    return [(i, v, "x", 1) for i, v in rows]


def test_search_ties_repeats_and_odd_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice((-1.0, -0.5, 0.25, 1.0)) for _ in range(4)]) for i in range(-40, 160)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 330)]
    rows += [(20, [1.0, 1.0, 1.0, 1.0]), (7, rows[0][1]), (7, rows[0][1])]
    rows += [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, -2.0]), (502, [0.1, 0.1])]
    for k in (1, 3, 20, 1000):
        assert searched(spark, with_extras(rows), k=k) == brute_topk(rows, 20, k)


@pytest.mark.parametrize("size", [1e3, 1e7, 1e12])
def test_search_is_exact_at_any_magnitude(spark, size):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.normal(0, size, 6)]) for i in range(120)]
    assert searched(spark, with_extras(rows), k=5) == brute_topk(rows, 20, 5)


def test_search_empty_and_many_leaves(spark):
    assert searched(spark, []) == []
    assert searched(spark, with_extras([(1, [1.0])])) == []
    assert searched(spark, with_extras([(20, [1.0])])) == []
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    assert searched(spark, with_extras(rows), k=4, parts=23) == brute_topk(rows, 20, 4)


def test_shard_search_over_many_tiles(monkeypatch):
    monkeypatch.setattr(exactsearch, "CHUNK", 32)
    rnd = np.random.default_rng(1)
    rows = rnd.integers(-3, 4, (1000, 5)).astype(float)
    rows[300:700] = rows[300]
    ids, asked = np.arange(1000) * 3, np.array([0, 6, 7, 900, 2997])
    parts = np.vstack([rows[0], rows[2], rows[5], rows[300], rows[999]])
    for dense in (0, 10**9):
        monkeypatch.setattr(exactsearch, "DENSE", dense)
        top = exactsearch.search_shard(asked, parts, ids, rows, 6)
        for q, (own, v) in enumerate(zip(asked, parts)):
            want = sorted((-int(v @ w), int(i)) for i, w in zip(ids, rows) if i != own)[:6]
            assert [(-int(s), int(i)) for s, i in zip(top.score[top.row == q], top.vec[top.row == q])] == want


# --------------------------------------------------------------------- phrases
def brute_phrases(rows, least, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    frequent = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    found = {}
    for (lang, p), a in frequent.items():
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (other, q), b in frequent.items() if other == lang and len(q) > len(p)
        )
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, totals[lang], -s)
                  for lang, got in found.items() for r, (s, a, p, left, right) in enumerate(sorted(got)[:first]))


def mined(spark, rows, least=3, first=10, parts=3):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, id int, phrase string").repartition(parts)
    got = phrases.collocations(df, least, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_phrases_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    words = ["New", "york", "CITY", "é", "Éa", "of", "the\t", "a", "名前", "b c", "x" * 50]
    rows = []
    for _ in range(150):
        text = "".join(rnd.choice(words) + rnd.choice((" ", " ", " ", "  ", ", ", ".", "\n", "\r\n", "\x0b")) for _ in range(rnd.randrange(0, 40)))
        rows.append((rnd.choice(("en", "fr", None)), text))
    rows += [("en", None), ("fr", ""), ("de", "..,;"), ("en", "a a a a a a a a")] + [("en", "one two three four five")] * 9
    assert mined(spark, rows) == brute_phrases(rows, 3, 10)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 500)
    assert mined(spark, rows, first=10_000, parts=1) == brute_phrases(rows, 3, 10_000)
    assert mined(spark, rows, first=10_000, parts=7) == brute_phrases(rows, 3, 10_000)


def test_bundles_round_trip():
    arrays = [np.array([], np.int64), np.array([-(1 << 62), 5, 1 << 40]), np.arange(1000)]
    for a, b in zip(arrays, phrases.opened(phrases.sealed(*arrays))):
        assert np.array_equal(a, b)


def test_phrases_of_small_blocks_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", "a b")] * 2) == []
    block = phrases.Block()
    block.add("en", b"b a b, a B")
    (rows,) = block.rows(4)
    lists = dict(zip(rows.column("word").to_pylist(), zip(rows.column("cnt").to_pylist(), rows.column("places").to_pylist())))
    assert {w: (n, np.cumsum(list(p)).tolist()) for w, (n, p) in lists.items()} == {"b": (3, [0, 2, 5]), "a": (2, [1, 4])}
    places = np.array([0, 127, 255, 2**31 - 1, 5, 2**30, 7])
    got = phrases.packed(places, np.array([0, 4, 6]))
    assert phrases.unpacked(got, np.array([4, 2, 1])).tolist() == places.tolist()


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 9 * 10**17, 9 * 10**17 + 7, 9 * 10**17 + 1
    df = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s"))
    assert df.first()[0] == 2_000_000 * a // (left + right)


def test_very_long_text_and_word(spark):
    rows = [("en", "w" * 1_000_000 + " z")] * 4 + [("en", "a b " * 300_000)]
    assert mined(spark, rows) == brute_phrases(rows, 3, 10)


# ---------------------------------------------------------------------- middle
def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = "<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]
    form, out = ("spm", s + p + m) if h4 % 100 < 20 else ("psm", p + s + m)
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_middle_against_plain_strings(spark):
    rnd = random.Random(2)
    pool = ["a", "Z", " ", "é", "ß", "名", "𝔘", "😀", "\n", "<", "<S", "P>", "\x00"]
    rows = [(i, "".join(rnd.choice(pool) * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 30)))) for i in range(300)]
    rows += [(None, "abc"), (5, None), (6, ""), (7, "x<P>y"), (8, "<M>"), (9, "é" * 5_000_000), (9, "é" * 5_000_000), (-3, "名a" * 3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], LONG + ", form string, output int")
    got = [tuple(r) for r in middle.middle_report(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=lambda r: repr(key(r))) == sorted((brute_middle(*r) for r in rows), key=lambda r: repr(key(r)))
    assert middle.middle_report(df.limit(0)).collect() == []


def test_runs_and_cuts(monkeypatch):
    monkeypatch.setattr(middle, "SLICE", 3)
    text = "aaé名名a😀😀b" * 3
    runs = middle.ClassRuns(text.encode())
    assert runs.units == len(text) and len(runs.width) == 16
    for cut in range(len(text) + 1):
        assert runs.byte_of(cut) == len(text[:cut].encode())


# --------------------------------------------------------------- decontamination
def test_short_frequent_items_are_reported_and_not_dropped(spark):
    docs = [(i, f"yes it is number {i}" if i % 2 else f"no, word{i} is not") for i in range(3000)]
    docs += [(5000, "zebra crossing rare here"), (5001, "one two three four five six seven eight nine ten"), (None, "yes")]
    docs = spark.createDataFrame(docs, LONG)
    items = spark.createDataFrame([(1, "Yes"), (2, "zebra crossing"), (3, "one two three four five six seven"), (None, "number 77")], "item_id long, text string")
    found = decontam.contamination_report(docs, items)
    assert found.where("item_id = 1").count() == 1501
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()}
    assert kept == set(range(3000)) - {77} | {None}
