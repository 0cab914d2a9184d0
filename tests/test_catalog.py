"""Every query against its SQL counterpart on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert sorted(duck.sql(sql).columns) == columns
    assert [TYPES[str(t)] for t in wanted.types] == [df.select(*columns).schema[c].dataType.simpleString() for c in columns]
    assert comparable(rows) == comparable(wanted.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_every_oracle_is_sql():
    assert [name for name, sql in entry_points.oracle_sql().items() if not isinstance(sql, str)] == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["part", "pos", "label", "count"] and df.count() > 30
