"""Every query with an oracle, against DuckDB."""

import os

import duckdb
import pytest

from mosaiq import queries as q


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None else round(x, 6) if isinstance(x, float) else str(x)
    return sorted(([plain(v[i]) for i in order] for v in values), key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, sf, con, name):
    wanted = con.sql(q.ORACLES[name])
    found = q.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(wanted.columns, wanted.fetchall())
