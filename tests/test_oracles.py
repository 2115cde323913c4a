"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from verify import rows_of
from workload.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
