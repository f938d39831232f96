"""Queries of the training-data problems against their SQL, where there is any, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.llm import queries
from tests.test_queries import TABLES, canonical

here = pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@here
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, sql, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in queries.SQL:
        assert rows
        return
    result = sql.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(canonical(r[c]) for c in columns) for r in rows) == want
