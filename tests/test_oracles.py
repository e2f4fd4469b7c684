"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(catalog.QUERIES), dict(catalog.ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    problem = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).take(1)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["users"] == 52 and 0 < row["map"] < 1


def test_every_query_is_registered_once():
    assert set(ORACLES) <= set(QUERIES)
    assert len(catalog.QUERIES) == 142
