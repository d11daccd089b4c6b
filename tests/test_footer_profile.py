"""Profiles from footers equal those of a scan."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from skyfare.operators.footer_profile import by_footers, footer_profile, footer_session

SCHEMA = (
    "n bigint, d double, day date, t timestamp_ntz, s string, list array<int>, none int, ok boolean, p string, q int"
)
DAY, TIME = datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4)
ROWS = [
    (5, 0.0, DAY, TIME, "b", [1], None, True, "x", 1),
    (None, None, None, None, None, None, None, None, "x", 1),
    (-7, 2.5, DAY, TIME, "ä", [], None, False, "y", 2),
    (2**60, -0.0, DAY, TIME, "", [2], None, True, None, 2),
]


def by_scan(df):
    rows = []
    for field in df.schema:
        column = F.col(field.name)
        ends = [F.lit(None)] * 2 if field.name == "list" else [F.min(column), F.max(column)]
        row = df.agg(F.count(F.lit(1)), F.count(column), *[e.cast("string") for e in ends]).first()
        rows.append((field.name, *[{"-0.0": "0.0"}.get(v, v) for v in row]))
    return rows


@pytest.mark.parametrize("extra", [[], [(1, float("nan"), DAY, TIME, "z", [3], 4, True, "y", 3)]])
@pytest.mark.parametrize("levels", [[], ["p", "q"]])
def test_profile_equals_a_scan(spark, tmp_path, extra, levels):
    path = str(tmp_path / "table")
    spark.createDataFrame(ROWS + extra, SCHEMA).repartition(3, "n").write.partitionBy(*levels).parquet(path)
    assert [tuple(r) for r in footer_profile(spark, path).collect()] == by_scan(spark.read.parquet(path))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert {tuple(r)[1:] for r in footer_profile(spark, path).collect()} == {(0, 0, None, None)}


def test_footers_answer(spark, tmp_path):
    """The plan reads no column: the aggregates are pushed into the scan."""
    path = str(tmp_path / "table")
    spark.range(1000).select("id", F.col("id").cast("double").alias("d")).write.parquet(path)
    stored = footer_session(spark).read.parquet(path)
    plan = by_footers(stored, list(stored.schema), ranges=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(d), MIN(id), MAX(id), MIN(d), MAX(d)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
