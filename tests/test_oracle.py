"""Every query that has SQL gives the same rows in DuckDB; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marginalia.plans import queries as engine

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        path = f"{DIR}/{f}" + ("/*.parquet" if os.path.isdir(f"{DIR}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    got = engine.QUERIES[name](spark, DIR)
    rows = got.collect()
    if name not in engine.SQL:
        assert rows or name in ("opr1_fts_snippets",)
        return
    found = duck.execute(engine.SQL[name])
    want, names = table([c[0] for c in found.description], found.fetchall())
    mine, own = table(got.columns, rows)
    assert own == names
    assert mine == want


def test_entry(spark):
    assert entry.entry(spark).columns and set(engine.SQL) <= set(engine.QUERIES) <= set(entry.queries())
