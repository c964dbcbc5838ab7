"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from cartulary.plans import registry


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["fid"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
