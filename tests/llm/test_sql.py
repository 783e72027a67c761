"""The queries of the subpackage that have SQL against DuckDB."""

import duckdb
import pytest

from pagewright.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(ORACLES[name])
    assert sorted(c[0] for c in want.description) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(([r[i] for i in at] for r in want.fetchall()), key=str) == sorted(([r[c] for c in columns] for r in df.collect()), key=str)
