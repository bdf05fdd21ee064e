"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, tables, name):
    want = tables.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    clean = lambda r: tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in r)
    assert sorted(map(repr, map(clean, got.select(*names).collect()))) == sorted(map(repr, map(clean, want.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(queries.SQL) <= set(entry.oracle_sql()) and set(queries.QUERIES) <= set(entry.queries())
