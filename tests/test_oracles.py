"""Every query with an SQL check against DuckDB: names, types and values."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(r[i] for i in order) for r in rows),
        key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cursor = con.execute(entry.oracle_sql()[key])
    want = cursor.fetchall()
    columns = [(d[0], str(d[1])) for d in cursor.description]
    assert sorted((c, TYPES[t]) for c, t in df.dtypes) == sorted(columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want, [c for c, _ in columns])
