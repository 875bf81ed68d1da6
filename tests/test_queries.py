"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from plumbline.workload import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
