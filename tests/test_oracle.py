"""Every named query against its SQL in DuckDB, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n in contract.oracle_sql()])
def test_query(spark, duck, name):
    problem = compare(contract.queries()[name](spark, SF), duck, contract.oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "date" and df.count() > 0
