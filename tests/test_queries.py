"""Every registered query against its SQL."""

import os

import pytest

from workload import load
from workload.check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    problems = [p for p in compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) if p != "no rows"]
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "rank" and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
