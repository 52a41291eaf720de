"""Every checkable query equals its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from cases.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
