"""Every query against its SQL in an independent engine."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    def plan_is_sound(df):
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
        # one task may only add up one partial row per task
        after = re.findall(r"Exchange SinglePartition.*\n(.*)", plan)
        assert all("HashAggregate(keys=[], functions=[partial_" in line for line in after)

    if name in SQL:
        ok, text = check(spark, con, name, QUERIES[name], SQL[name], SF, plan_is_sound)
        assert ok, text
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["category"] for r in rows} == {"api_call", "database_read", "serialization"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
