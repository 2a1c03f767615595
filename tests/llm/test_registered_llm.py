"""The registered queries of the subpackage against their SQL at the smallest scale."""

import os

import pytest

from lurewatch.llm.oracle import ORACLE
from lurewatch.llm.queries import QUERIES
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 1 + len(QUERIES)))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    outcome = compare(spark, con, FOLDER, QUERIES[name], ORACLE.get(name))
    assert outcome.startswith(("ok", "rows only")) and "types" not in outcome, outcome
