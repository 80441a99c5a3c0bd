"""Every registered query against its SQL in DuckDB, over whole tables."""

import os

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as registered
from eventlens.plans.catalog import QUERIES
from eventlens.plans.oracle import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= registered.queries().keys() and ORACLES.keys() <= registered.oracle_sql().keys()


def test_entry(spark):
    found = registered.entry(spark)
    assert found.columns == ["bucket", "group_0", "name", "value"]
    assert found.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(registered.queries()[name](spark, SF_DIR))
    wanted_columns, wanted = duck_rows(con, registered.oracle_sql()[name])
    assert columns == wanted_columns
    assert rows == wanted
