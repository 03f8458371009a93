"""Every query with SQL of its own against DuckDB on the same tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from tessera.plans import geometry_queries, site_queries, store_queries  # noqa: F401
from tessera.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, data, duck):
    found = QUERIES[name](spark, data)
    rows = found.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    got = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want)
