"""Queries of this subpackage with DuckDB SQL give its rows."""

import duckdb
import pytest

from lectern.llm import queries


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_duckdb(spark, data, name, folder):
    data = data.replace("sf0.001", folder)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in ("clicks", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(map(plain, row)) for row in result.fetchall()), key=repr)
    frame = queries.QUERIES[name](spark, data)
    assert sorted(frame.columns) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr) == want
