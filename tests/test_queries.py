import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canonical
from tests.conftest import SF
from workload.oracles import all_oracles
from workload.queries import all_queries


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_oracles())


def test_entry_points_hold_every_query():
    assert set(all_queries()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, db, name):
    got = all_queries()[name](spark, SF).toPandas()
    expected = db.execute(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)
