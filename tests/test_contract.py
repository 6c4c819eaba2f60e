"""The library's own registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from corridor.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(contract.queries()) and set(catalog.ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert set(df.columns) == {"period", "stamp", "bridge", "avg_speed", "max_speed", "ci", "t"}
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    assert compare(contract.queries()[name](spark, FOLDER), duck, contract.oracle_sql()[name]) == []
