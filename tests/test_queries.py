"""Every query of the core against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera import catalog

TABLES = "passages doc_index postings lexicon topics qrels hits documents".split()


def canonical(value):
    return f"{value:.5f}" if isinstance(value, float) and math.isfinite(value) else str(value)


@pytest.fixture(scope="module")
def sql(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, sql, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    statement = __spark_entry__.oracle_sql().get(name)
    if statement is None:
        assert rows
        return
    result = sql.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(canonical(r[c]) for c in columns) for r in rows) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
