"""Hard negatives and task features against plain Python."""

import random
import re

from spanloom.operators import mining


def test_hard_negatives_against_plain_python(spark):
    rnd = random.Random(12)
    names = ["get", "Getter", "getter_all", "set", "Reset", "x", "load", "loader", "é", "zebra"]
    rows = [(i, f"f{rnd.randrange(12)}", rnd.choice(names)) for i in range(60)]
    df = spark.createDataFrame(rows, "place long, path string, name string")
    for n in (1, 2, 5):
        want = []
        for i, path, name in rows:
            own = [("same_file", j) for j, p, m in rows if p == path and m != name]
            like = [("similar_name", j) for j, p, m in rows if p != path and (name.lower() in m.lower() or m.lower() in name.lower())]
            want += [(i, j, kind, r) for r, (kind, j) in enumerate((sorted(own) + sorted(like))[:n], 1)]
        got = mining.hard_negatives(df.repartition(3), n).select("place", "negative", "kind", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert mining.hard_negatives(df.where("false")).collect() == []


def test_graph_support_against_plain_python(spark):
    tasks = [(1, "Load the zebra config"), (2, "a b"), (3, None), (4, "ZEBRA zebra")]
    edges = [("IMPORTS", f"src/{i}.py", t) for i, t in enumerate(["zebra", "x", "Zebras", "loader", "the", "none", "config", "zebra"])]
    got = {r["task_id"]: r for r in mining.graph_support(
        spark.createDataFrame(tasks, "task_id int, query string"), spark.createDataFrame(edges, "edge string, src string, dst string")).collect()}
    for i, query in tasks:
        toks = {t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", query or "")}
        met = [e for e in edges if any(t in e[1].lower() or t in e[2].lower() for t in toks)]
        r = got[i]
        assert (r["support_count"], r["support_paths"], r["edge_types"]) == (len(met), sorted({e[1] for e in met})[:5], sorted({e[0] for e in met}))
        assert abs(r["confidence_boost"] - min(0.2, 0.03 * len(met))) < 1e-9
