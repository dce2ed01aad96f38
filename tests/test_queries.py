"""Every query with SQL against DuckDB, and the contract's functions."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tesserae.plans import queries as reference

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, records):
    key = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: ("nan" if math.isnan(v) else f"{v + 0.0:.5g}") if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in key) for r in records)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    found = reference.QUERIES[name](spark, sf)
    expected = duck.sql(reference.SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "v"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
