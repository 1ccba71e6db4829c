"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.queries import QUERIES
from checks.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@needs_tables
def test_entry(spark):
    assert entry(spark).count() == 150


@needs_tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None
