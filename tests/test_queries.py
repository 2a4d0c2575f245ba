"""Every registered query against its SQL on the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from runlens.workload.oracle import ORACLE
from runlens.workload.queries import QUERIES
from check import connect, difference

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.keys() <= contract.queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 20
