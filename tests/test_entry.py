"""The driver's contract: names, oracles, and results equal to DuckDB's on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from markloom import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(engine.QUERIES) >= 30


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_equals_sql(spark, db, name):
    df = engine.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = db.execute(engine.SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=key)
