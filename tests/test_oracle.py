"""Every registered query against its DuckDB oracle on the smallest fixture (the driver's gate)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from prefspark.plans.registry import QUERIES as REGISTERED, load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
# the library's own queries; those of the optional subpackage have tests in tests/llm
OWN = set(load_all() or REGISTERED)
QUERIES = {k: v for k, v in E.queries().items() if k in OWN}
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_name_convention():
    for name in QUERIES:
        prefix = name.split("_")[0]
        assert prefix[0] in "psljgwufxt" and prefix[1:].isdigit(), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF, name, QUERIES[name], ORACLES.get(name), con)
    assert r["status"] in ("OK", "rows-only"), r


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_or_row_udf(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
