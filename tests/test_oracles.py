"""Every query with an oracle statement against DuckDB: the smallest tables, or the next where those hold no row for a rule."""

import pytest

import __spark_entry__ as entry_point
from cohortline.plans.catalog import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER, NEXT = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    problems = compare(spark, FOLDER, QUERIES[name], ORACLES[name], con)
    if problems == ["oracle is empty"]:
        problems = compare(spark, NEXT, QUERIES[name], ORACLES[name])
    assert problems == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_fits_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns[0] == "arm"
