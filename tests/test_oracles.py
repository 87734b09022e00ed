"""Every query with an oracle gives DuckDB's rows on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from lectern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value)[:26] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_duckdb(spark, data, duck, name):
    frame = catalogue.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0
