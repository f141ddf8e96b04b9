"""Plans against their SQL on the smallest tables; oracle_check.py runs all of them at any size."""

import os

import pytest

import __spark_entry__ as contract
from oracle_check import compare, duck
from sparkrisk.plans import catalog  # noqa: F401  (registers the plans)
from sparkrisk.plans.registry import ORACLES, PLANS

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


WITH_SQL = [n for n in PLANS if n in ORACLES]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", WITH_SQL)
def test_plan_equals_sql(spark, con, name):
    rows, verdict = compare(spark, con, name, PLANS[name], ORACLES[name], SF_DIR)
    assert verdict == "ok"


def test_contract(spark):
    assert contract.entry(spark).columns == ["decision", "n", "share", "positives", "negatives", "positive_rate"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 100
    assert set(PLANS) == set(ORACLES)
