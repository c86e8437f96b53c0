"""Registered queries against their SQL on the smallest tables."""

import pytest

from workload import all_queries
from workload.check import compare, duck
from workload.registry import ORACLES

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
CHOSEN = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    ok, note = compare(spark, SF, con, name, QUERIES[name], ORACLES.get(name))
    assert ok, note
