"""JSON walks and canaries."""

import json

from spanloom.operators import governance


def walked(value, depth=1):
    if isinstance(value, dict):
        for k, v in value.items():
            yield depth, k
            yield from walked(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from walked(v, depth + 1)


def test_json_fields_against_plain_python(spark):
    values = [{"a": {"b": [1, {"c": {"d": None}}]}, "e": '"gold": 1'}, [], {}, [[[{"x": 1}, {"x": 2}]]], "text", 3, None, {"": {"é": []}}, {"gold": {"gold": "gold"}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, "{not"), (102, "")]
    got = governance.json_fields(spark.createDataFrame(rows, "id int, j string"), "id", "j")
    assert sorted(map(tuple, got.collect())) == sorted((i, *f) for i, v in enumerate(values) for f in walked(v))
    assert governance.json_fields(spark.createDataFrame([], "id int, j string"), "id", "j").collect() == []
    counted = governance.private_fields(spark.createDataFrame(rows, "id int, j string"), "j", ["gold", "x", "none"])
    assert sorted(map(tuple, counted.collect())) == [("gold", 2), ("x", 2)]


def test_canaries(spark):
    texts = spark.createDataFrame([(1, "xCANARY1y"), (2, "canary1"), (3, None), (4, "CANARY1 CANARY2")], "id int, body string")
    tokens = spark.createDataFrame([("CANARY1",), ("CANARY2",), ("CANARY2",), (None,)], "token string")
    assert sorted(map(tuple, governance.canary_hits(texts, "id", "body", tokens).collect())) == [(1, "CANARY1"), (4, "CANARY1"), (4, "CANARY2")]
