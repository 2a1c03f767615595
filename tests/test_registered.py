"""Registered queries against their SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from lurewatch.plans.registered import QUERIES
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_has_known_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# The queries of the optional subpackage have tests of their own.
NAMES = sorted(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    outcome = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert outcome.startswith(("ok", "rows only")) and "types" not in outcome, outcome


def test_no_query_spreads_small_tables(spark):
    plan = entry.queries()["verdict_summary"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "REPARTITION" not in plan.upper()


def test_links_are_parsed_once_and_not_shuffled(spark):
    plan = QUERIES["href_links"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    plan = QUERIES["lookalike_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tables_kept_as_folders_stream_whole(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(5).write.parquet(f"{tmp_path}/documents_old.parquet")
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert QUERIES["stream_verdicts"](spark, str(tmp_path)).count() == rows
