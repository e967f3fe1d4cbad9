"""Every registered query against its SQL oracle on the smallest driver tables, and rules for plans."""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = os.environ.get("TALLY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def check_plan(df):
    """No Python in the plan and no join without a key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|EvalPython|MapInPandas|FlatMapGroups", plan)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, SF, QUERIES[name], ORACLES[name], check_plan) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["model", "arm", "task", "episodes", "matches", "accuracy"]
