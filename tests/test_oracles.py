"""Every query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from spanloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.6g}") + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in place)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_and_repeatable(spark, sf, name):
    first = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert first
    assert first == sorted(map(repr, QUERIES[name](spark, sf).collect()))


def test_views_of_odd_documents(spark, tmp_path):
    four = "a\n" * 4
    rows = [(5, four), (6, four), (65, four), (31, ""), (32, ""), (61, None), (30, None), (25, None), (10, "x"), (10, "x"), (10, "x\n" * 9), (10, None), (81, "a"), (81, None), (-5, "a"), (None, "a"), (None, None), (36, "a\r\n" * 5)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, QUERIES["view_validate"](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(repr, con.execute(ORACLES["view_validate"]).fetchall()))
    # A final line feed begins one more line.
    assert "(5, 'valid')" in got and "(6, 'range_invalid')" in got and "(65, 'stale')" in got
