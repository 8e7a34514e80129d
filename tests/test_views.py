"""Views of small files by hand, and ranks against plain loops."""

import math

from pyspark.sql import functions as F

from spanloom.operators import views

PY = "\n# far\n\n# one\n# two\n# three\n# four\n\ndef load(a):\n    assert a\n    return a\n\nclass Big:\n    pass\n"
TS = "import x\nexport function go() {\n}\nexport class Box {}\nrouter.get('/a', go)\nplain\n"
TOML = "[a]\nkey = 1\n  other.name: 2\nnot a key\n"
FILES = [("r", "src/tests/a.py", "s1", "python", PY), ("r", "b.ts", "s2", "typescript", TS), ("r", "c.toml", "s3", "toml", TOML), ("r", "d.txt", "s4", None, "\n \nonly words\n"), ("r", "e.py", "s5", "python", ""), ("r", "f.py", "s6", "python", None)]


def _files(spark):
    return spark.createDataFrame(FILES, "repo_id string, path string, content_sha string, language string, content string").withColumn("view", F.lit("clash")).withColumn("text", F.lit("clash"))


def _by_path(spark, path):
    out = {}
    for r in views.file_views(_files(spark)).where(F.col("path") == path).collect():
        out.setdefault(r["view"], []).append((r["ordinal"], r["start_line"], r["end_line"], r["text"], r["data_level"]))
    return {v: sorted(rows) for v, rows in out.items()}


def test_views_of_python(spark):
    got = _by_path(spark, "src/tests/a.py")
    assert got["path_plus_symbol"] == [(1, 9, 9, "path src/tests/a.py language python symbol load kind function", 0), (2, 13, 13, "path src/tests/a.py language python symbol Big kind class", 0)]
    assert got["signature_only"][0] == (1, 9, 9, "function load def load(a):", 1)
    # The last three comments above, behind blanks; none behind a code line.
    assert got["signature_plus_doc"] == [(1, 6, 9, "# two\n# three\n# four\ndef load(a):", 1), (2, 10, 13, "class Big:", 1)]
    assert got["ast_header"] == [(1, 9, 11, "def load(a):\n    assert a\n    return a", 1), (2, 13, 14, "class Big:\n    pass", 1)]
    assert got["comment_docstring"] == [(1, 2, 7, "# far\n# one\n# two\n# three\n# four", 1)]
    assert got["test_name_plus_assert_terms"] == [(1, 1, 14, "test file src/tests/a.py\nassert a", 1)]
    assert got["raw_code_trimmed"][0][1:3] == (1, 14) and "\n\n" not in got["raw_code_trimmed"][0][3]
    assert [r[3].split("\n")[0] for r in got["mixed_all_views"]] == ["path_plus_symbol"] * 2 + ["signature_plus_doc"] * 2 + ["comment_docstring"]
    assert [r[4] for r in got["mixed_all_views"]] == [0, 0, 1, 1, 1]
    assert "config_key_plus_context" not in got and "route_plus_handler_signature" not in got


def test_views_of_other_files(spark):
    ts = _by_path(spark, "b.ts")
    # TypeScript has JavaScript's patterns too: a function twice, a class as class and as type.
    assert [(r[1], r[3].split("symbol ")[1]) for r in ts["path_plus_symbol"]] == [(2, "go kind function"), (2, "go kind function"), (4, "Box kind class"), (4, "Box kind type")]
    assert ts["route_plus_handler_signature"] == [(1, 5, 6, "route handler path b.ts\nrouter.get('/a', go)", 1)]
    toml = _by_path(spark, "c.toml")
    assert toml["path_plus_symbol"] == [(1, 1, 3, "path c.toml language toml basename c", 0)]
    assert toml["config_key_plus_context"] == [(1, 1, 4, "config path c.toml keys key other.name", 1)]
    assert set(_by_path(spark, "d.txt")) == {"path_plus_symbol", "raw_code_trimmed", "mixed_all_views"}
    assert _by_path(spark, "e.py") == _by_path(spark, "f.py") == {}


def test_counts_are_bounded(spark):
    text = "".join(f"# c{i}\ndef f{i}():\n" for i in range(100))
    rows = [("r", "m.py", "s", "python", text)]
    got = views.file_views(spark.createDataFrame(rows, "repo_id string, path string, content_sha string, language string, content string"))
    counts = {r["view"]: r["count"] for r in got.groupBy("view").count().collect()}
    assert counts["signature_only"] == counts["ast_header"] == 80 and counts["mixed_all_views"] == 5
    comment = got.where("view = 'comment_docstring'").first()
    assert (comment["start_line"], comment["end_line"]) == (1, 23) and comment["text"].count("\n") == 23


def test_ranks_against_loops(spark):
    made = views.file_views(_files(spark)).withColumn("repo_id", F.when(F.col("path") == "c.toml", "other").otherwise("r"))
    made = made.unionByName(made.withColumn("path", F.concat(F.lit("z/"), "path")))  # ties
    tasks = [(1, "r", "load of Big"), (2, "other", "key name"), (3, "r", None), (4, None, "load"), (5, "r", "go router language python")]
    got = views.rank_views(made, spark.createDataFrame(tasks, "task_id long, repo_id string, query string"), 2)
    want = []
    rows = made.collect()
    for task, repo, query in tasks:
        if repo is None or not query:
            continue
        q = views.hashed_vector(f"query {query}")
        for view in views.VIEWS:
            scored = []
            for r in rows:
                if r["view"] == view and r["repo_id"] == repo:
                    v = views.hashed_vector(r["text"])
                    norm = math.sqrt(float(q @ q)) * math.sqrt(float(v @ v))
                    if norm and round(float(q @ v) / norm, 6) > 0:
                        scored.append((-round(float(q @ v) / norm, 6), r["path"], r["ordinal"]))
            want += [(task, view, n, p, o, -s) for n, (s, p, o) in enumerate(sorted(scored)[:2], 1)]
    mine = sorted((r["task_id"], r["view"], r["rank"], r["path"], r["ordinal"], r["score"]) for r in got.collect())
    assert mine == sorted(want) and len({m[1] for m in mine}) > 5
    files = views.rank_files(got, 3).collect()
    for r in files:
        assert r["score"] == max(m[5] for m in mine if m[0] == r["task_id"] and m[3] == r["path"])


def test_no_tasks_no_files(spark):
    made = views.file_views(_files(spark))
    none = spark.createDataFrame([], "task_id long, repo_id string, query string")
    assert views.rank_views(made, none, 2).count() == 0
    one = spark.createDataFrame([(1, "r", "load")], "task_id long, repo_id string, query string")
    assert views.rank_views(made.where("false"), one, 2).count() == 0
    assert views.file_views(_files(spark).where("false")).count() == 0
