"""Queries with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from veldspar.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{small}/{t}'")
    df = queries.QUERIES[name](spark, small)
    expected = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    tidy = lambda rows, columns: sorted(tuple(str(r[columns.index(c)]) for c in order) for r in rows)
    assert tidy(df.collect(), df.columns) == tidy(expected.fetchall(), expected.columns)
