"""Registered training-text queries against their SQL, over whole tables."""

from __future__ import annotations

import os

import pytest

pytest.importorskip("skyfare.llm")

from compare import connect, differences
from skyfare.llm.oracle import ORACLE
from skyfare.llm.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, con, name):
    df, sql = QUERIES[name](spark, SF_DIR), ORACLE[name]
    if name == "op2_nearest_neighbours":  # the engines add up products in orders of their own
        df, sql = df.drop("score"), f"SELECT query_id, rank, vec_id FROM ({sql})"
    assert differences(df, con, sql) == []
