import os

import pytest

import __spark_entry__
from oracle_check import connect, differences

from buzzlens.plans.catalog import QUERIES
from buzzlens.plans.oracles import ORACLES

DIRECTORY = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no sample tables")


@pytest.fixture(scope="module")
def database():
    return connect(DIRECTORY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, database, name):
    problem = differences(spark, database, DIRECTORY, name, QUERIES[name], ORACLES[name])
    assert problem is None


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
