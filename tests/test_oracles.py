"""Every registered query beside its SQL counterpart on the smallest data."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows_of
from querycorpus.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        assert got
        return
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 27
