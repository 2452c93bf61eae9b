"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from veldspar import queries


def values(rows, columns, order):
    return sorted(tuple(str(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{small}/{t}'")
    df = queries.QUERIES[name](spark, small)
    expected = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    assert values(df.collect(), df.columns, order) == values(expected.fetchall(), expected.columns, order)


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries(spark, small):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, small).count() > 0
