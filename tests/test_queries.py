"""Every registered query runs and gives the rows of its SQL (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from crestline.registry import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    ok, text = compare.compare(spark, con, sf, name)
    assert ok, text
