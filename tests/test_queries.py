"""Every registered query against the same question asked of another engine."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference
from waybill.plans import catalog


@pytest.fixture(scope="module")
def engine(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows(spark, folder, engine, name):
    result = entry_points.queries()[name](spark, folder)
    assert difference(result, engine, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
