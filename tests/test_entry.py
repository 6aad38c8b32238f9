"""The registry: queries and their SQL at the smallest scale, on clean plans."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p1_", "p6_"))))
def test_same_as_sql(spark, name):
    assert compare(spark, SMALL, entry.queries()[name], entry.oracle_sql()[name]) == ""
