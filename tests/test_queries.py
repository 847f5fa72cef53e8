"""All registered queries against their SQL, and the shape of their plans."""

import re

import pytest

import __spark_entry__ as contract
import check_oracle
from tests.conftest import executed_plan
from tidegauge.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Queries of the library itself.
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    verdict, n, _ = check_oracle.compare(spark, con, name, SF)
    assert verdict == "ok"
    assert n > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and set(NAMES) <= set(contract.queries()) and set(NAMES) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "active_n" in df.columns


BATCH = [n for n in NAMES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_rows_and_no_cartesian_products(spark, name):
    plan = executed_plan(contract.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|BatchEval|MapInPandas|InPandas", plan)


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = executed_plan(contract.queries()["active_samples"](spark, SF))
    assert "EqualTo(event_type,click)" in plan and "ts" not in re.search(r"ReadSchema: (.*)", plan).group(1)
    # the query returns all partitions; what is asked of it is cut to its partitions
    plan = executed_plan(contract.queries()["stored_samples"](spark, SF).filter("device = 'error'"))
    assert re.search(r"PartitionFilters: \[[^\]]*isnotnull\(device#", plan)


def test_slots_of_bursts_are_built_once(spark):
    plan = executed_plan(contract.queries()["bursts"](spark, SF))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
