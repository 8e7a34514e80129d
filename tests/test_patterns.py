"""Search for many strings and patterns at once, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from spanloom.operators import lexical, linesearch, manypatterns
from spanloom.plans import context

FILES = "path string, language string, content string, repo_id string, content_sha string"


def files_of(spark, rows):
    return spark.createDataFrame([(*r, "r", "sha")[:5] for r in rows], FILES)


def test_containing_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(manypatterns, "PIECE_BYTES", 200)
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abé名 ") for _ in range(n))
    texts = [(i, some(rnd.randrange(60))) for i in range(80)] + [(100, None), (101, "")]
    strings = [(i, some(rnd.randrange(1, 5))) for i in range(60)] + [(70, ""), (71, None), (72, "ab"), (73, "ab")]
    got = manypatterns.containing(spark.createDataFrame(texts, "key int, text string").repartition(3), spark.createDataFrame(strings, "id long, pattern string"))
    want = [(k, i) for k, t in texts if t is not None for i, s in strings if s is not None and s in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = manypatterns.containing(spark.createDataFrame([], "key int, text string"), spark.createDataFrame([], "id long, pattern string"))
    assert none.collect() == []


def test_required_literal():
    cases = {"foo.*barbaz": "barbaz", "^load$": "load", "(?i)foo": "", "a|b": "", "ab(cd)?efg": "efg", "x+yz": "yz", "[": None, "": "", "foo\\.bar": "foo.bar"}
    assert {p: linesearch.required_literal(p) for p in cases} == cases


def test_line_hits_against_plain_python(spark):
    files = [
        ("a.py", "python", "def load_zebra(x):\n    return preload_zebras(1)\r\n\nload_zebra\n"),
        ("b.rs", "rust", "fn load_zebra() {}\nfoo then bar\nfoo\nbar foo.*bar\n"),
        ("c.txt", "unknown", "class load_zebra\n" + "load_zebra\n" * 5), ("d", None, "def load_zebra"), ("e", "python", None), ("f", "python", ""),
    ]
    queries = [(1, "load_zebra"), (2, "foo.*bar"), (3, "["), (4, None), (5, "^$"), (6, "(?i)FOO"), (7, "load zebra")]
    got = sorted(map(tuple, linesearch.line_hits(files_of(spark, files), spark.createDataFrame(queries, "query_id int, query string"), linesearch.KINDS).collect()))
    want = []
    for path, language, content in files:
        lines = [x.removesuffix("\r") for x in content.removesuffix("\n").split("\n")] if content else []
        for i, q in queries:
            for n, line in enumerate(lines, 1):
                if q is not None and q != "[" and re.search(q, line):
                    want.append((i, "regex", path, n))
                if q is not None and q in line:
                    want.append((i, "text", path, n))
                if q is not None and any(language in (of, "unknown") and re.search(p, line) for of, _, p in lexical.symbol_patterns(q)):
                    want.append((i, "symbol", path, n))
    assert got == sorted(want)
    first = linesearch.line_hits(files_of(spark, files), spark.createDataFrame(queries[:1], "query_id int, query string"), ("text",), 2).where("path = 'c.txt'")
    assert [r["line_no"] for r in first.orderBy("line_no").collect()] == [1, 2]


def test_whole_query_counts_where_it_is_cut_inside_words(spark):
    files = files_of(spark, [("p", "x", "preload zebra"), ("q", "x", "load a zebra"), ("r", "x", "oad zebr")])
    got = lexical.symbol_overlap(files, spark.createDataFrame([(1, "load zebra"), (2, "eload zeb"), (3, "")], "query_id long, query string"), 5)
    assert [(r["query_id"], r["path"], r["score"]) for r in got.orderBy("query_id", "rank").collect()] == [(1, "p", 4.0), (1, "q", 2.0), (2, "p", 3.0)]


def test_regex_and_text_are_one_list(spark):
    files = files_of(spark, [("a", "python", "x = preload_zebras(1)\nfoo then bar\nfoo.*bar"), ("b", "python", "def load_zebra")])
    q = spark.createDataFrame([(1, "load_zebra"), (2, "foo.*bar")], "query_id long, query string")
    got = context.channel_hits(files, q, ("regex", "text", "symbol"), 5).orderBy("query_id", "channel", "rank")
    assert [(r["query_id"], r["channel"], r["rank"], r["path"], r["start_line"]) for r in got.collect()] == [
        (1, "regex", 1, "a", 1), (1, "regex", 2, "b", 1), (1, "regex", 3, "a", 1), (1, "regex", 4, "b", 1), (1, "symbol", 1, "b", 1),
        (2, "regex", 1, "a", 2), (2, "regex", 2, "a", 3), (2, "regex", 3, "a", 3),
    ]


def test_stem_tests_stay_in_their_repository(spark):
    rows = [
        ("src/zebra.py", "python", "code", "r1"), ("src/Makefile", "python", "code", "r1"), ("other/zebra.rs", "rust", "code", "r2"),
        ("tests/all.py", "python", "import zebra, Makefile", "r1"), ("plain.py", "python", "x\nassert zebra", "r2"), ("quiet.py", "python", "zebra", "r2"),
    ]
    got = manypatterns.stem_tests(files_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == [
        ("plain.py", "other/zebra.rs", "tests"), ("tests/all.py", "src/Makefile", "tests"), ("tests/all.py", "src/zebra.py", "tests")]
