"""Queries with SQL against DuckDB on the given tables."""

import os

import duckdb
import pytest

from larder.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    theirs = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(theirs.select(*columns).fetchall(), key=repr)
