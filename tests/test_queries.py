"""Every registered query of the core with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from sitelattice.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def shown(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = core.queries()[name](spark, SF).toPandas()
    want = duck.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_all_queries_have_distinct_columns(spark):
    for name, query in core.queries().items():
        columns = query(spark, SF).columns
        assert len(columns) == len(set(columns)), name
