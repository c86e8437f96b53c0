"""Registered queries against their SQL on the smallest tables, and against brute force."""

import pytest

from capsonde.llm import registry as R
from tests.llm import brute
from workload.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, SF, con, name, R.QUERIES[name], R.ORACLES.get(name))
    assert ok, note


def test_byte_dedup_of_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in R.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = R.QUERIES["op9_suffix_array_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute.dedup_bytes(docs)
