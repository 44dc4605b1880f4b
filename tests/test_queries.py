"""Every registered query against its SQL on the sample tables, and the shape of its plan."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

from .compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
# Queries that fit models run actions of their own and are covered by the model tests.
FITTED = {"benchmark", "predict_drivers"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_but_the_fitted_ones_has_sql():
    assert set(QUERIES) - set(ORACLES) == FITTED and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_result_and_plan(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 20
