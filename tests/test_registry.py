"""Every registered query against its SQL."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from skyfare.registry.oracle import ORACLE
from skyfare.registry.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["date", "total_trips"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert differences(df, con, ORACLE[name]) == []
