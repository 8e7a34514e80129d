"""Ignore files against hand-worked trees."""

import pytest

from spanloom.sources import corpus, ignore


def left(spark, rules, paths, git=True):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = ignore.not_ignored(files, ignore.rules_of(spark.createDataFrame(list(rules.items()), "path string, content string"), git))
    return sorted(r["path"] for r in got.collect())


@pytest.mark.parametrize("rule, out, kept", [
    ("*.log", ["a.log", "x/b.log", ".log"], ["a.log.txt", "alog"]),
    ("/todo", ["todo", "todo/x"], ["a/todo", "todos"]),
    ("build/", ["build/a", "x/build/a/b"], ["y/build", "builds/a"]),
    ("a/b", ["a/b", "a/b/c"], ["x/a/b", "a/bb"]),
    ("**/foo", ["foo", "a/b/foo", "foo/x"], ["afoo"]),
    ("abc/**", ["abc/x", "abc/y/z"], ["abc", "x/abc/y"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb", "ab"]),
    ("doc?.md", ["doc1.md", "x/docx.md"], ["doc12.md", "doc/.md"]),
    ("v[0-9].[!a]", ["v1.b", "v9.c"], ["vx.b", "v1.a"]),
    ("a*c/d", ["abbc/d", "ac/d"], ["a/c/d", "x/ac/d"]),
    ("\\#x", ["#x"], ["x"]), ("\\!y", ["!y"], ["y"]), ("z\\ ", ["z "], ["z"]), ("q  ", ["q"], ["q  "]),
    ("# note\n\n!\n/\n", [], ["note", "#"]), ("a.b", ["a.b"], ["axb"]), ("é*", ["éa"], ["ea"]),
])
def test_single_rules(spark, rule, out, kept):
    assert left(spark, {".gitignore": rule}, out + kept) == sorted(kept)


def test_precedence(spark):
    rules = {
        ".gitignore": "*.log\n!keep.log\nkeep.log.d/\n*.tmp\n!a.tmp\na.tmp\nout/\n", "in/.gitignore": "!*.log\n/here\n", "in/deep/.gitignore": "*.log\n",
        "in/.ignore": "x.log", "out/.gitignore": "!*", ".git/info/exclude": "*.ex\nkeep.log", "other/.gitignore": "",
    }
    paths = ["a.log", "keep.log", "a.tmp", "in/a.log", "in/x.log", "in/here", "in/deep/here", "in/deep/b.log", "out/a", "b.ex", "other/c", "sub/keep.log"]
    assert left(spark, rules, paths) == ["in/a.log", "in/deep/here", "keep.log", "other/c", "sub/keep.log"]
    assert left(spark, rules, paths, git=False) == sorted(set(paths) - {"in/x.log"})
    assert left(spark, {}, paths) == sorted(paths) and left(spark, rules, []) == []


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in {".gitignore": "*.log\nnode/\n", "a.py": "x", "b.log": "y", "node/c.py": "z", "d/.gitignore": "!b.log", "d/b.log": "w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = lambda **kw: {r["path"] for r in corpus.scan_folder(spark, str(tmp_path), [], [], **kw).collect()}
    assert paths() == {".gitignore", "a.py", "d/.gitignore", "d/b.log"}
    assert paths(gitignored=True) == {".gitignore", "a.py", "b.log", "node/c.py", "d/.gitignore", "d/b.log"}
