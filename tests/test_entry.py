import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
own = {k: v for k, v in entry.queries().items() if k.startswith("q_")}
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(own) > 90


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    return str(v) if hasattr(v, "isoformat") else v


@needs_data
@pytest.mark.parametrize("name", sorted(k for k in own if k in entry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = own[name](spark, SF)
    got = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    theirs = sorted(([plain(r[k]) for k in at] for r in got.fetchall()), key=repr)
    ours = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert ours == theirs
