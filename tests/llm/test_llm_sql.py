"""Queries of the training-data operators that SQL can express give the same rows as DuckDB."""

import os

import duckdb
import pytest

from sitelattice.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in os.listdir(SF):
        connection.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got, want = llm.queries()[name](spark, SF).toPandas(), connection.sql(llm.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    shown = lambda f: sorted(tuple(map(str, r)) for r in f[columns].itertuples(index=False))
    assert shown(got) == shown(want)
