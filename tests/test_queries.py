"""Every registered query against its oracle at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from checks.fixtures import GIVEN
from checks.registry import ORACLES, QUERIES
from verify import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in GIVEN:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "deid_text"] and df.count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = contract.queries()[key](spark, SF)
    cursor = duck.execute(contract.oracle_sql()[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
