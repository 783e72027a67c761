"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from pagewright.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    sql = duck.sql(ORACLES[name])
    assert sorted(sql.columns) == columns
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: KINDS.get(k) for c, k in df.dtypes} == kinds
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in sql.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
