"""Each registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from varigrid import queries as core

SLOW = {"dbscan_events"}


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - SLOW))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    found = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert found == rows_of(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
