from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from skyfare.operators.quality import (
    NonEmpty,
    NotNullRate,
    UniqueRatio,
    check_table,
    failed_checks,
    quality_report,
    require_quality,
    value_range,
)
from skyfare.sources import buckets
from skyfare.sources.files import list_partitions


def messages(spark, data, schema, rules):
    return failed_checks(check_table(spark.createDataFrame(data, schema), "t", rules))


def test_row_count(spark):
    assert messages(spark, [(1,)], "a int", [NonEmpty()]) == []
    assert messages(spark, [], "a int", [NonEmpty()]) == ["t: row count is zero"]


def test_not_null_rate(spark):
    half = [NotNullRate(columns=("a",), threshold=0.5)]
    assert messages(spark, [(1,), (None,)], "a int", half) == []  # equal to the threshold holds
    assert messages(spark, [(1,), (None,), (None,)], "a int", half) == [
        "t: column 'a' non-null rate 0.333 < 0.500"
    ]
    assert messages(spark, [], "a int", half) == ["t: cannot evaluate null-rate on empty table"]
    assert messages(spark, [(1,)], "b int", half) == ["t: missing required column 'a'"]


def test_rates_are_printed_as_their_exact_value(spark):
    for filled, rows in [(1617, 2000), (1533, 2000), (1, 3), (2, 3), (0, 5), (1, 16)]:
        data = [(1,)] * filled + [(None,)] * (rows - filled)
        (text,) = messages(spark, data, "a int", [NotNullRate(columns=("a",), threshold=1.0)])
        assert text == f"t: column 'a' non-null rate {filled / rows:.3f} < 1.000"


def test_value_range(spark):
    rules = value_range("a", low=0.0, high=10.0)
    assert messages(spark, [(0.0,), (10.0,), (None,)], "a double", rules) == []
    assert messages(spark, [(-1.5,), (11.0,)], "a double", rules) == [
        "t: column 'a' min -1.5 < 0.0",
        "t: column 'a' max 11.0 > 10.0",
    ]
    assert messages(spark, [(None,)], "a double", rules) == []
    assert messages(spark, [], "a double", rules) == []
    assert messages(spark, [(float("nan"),), (1.0,)], "a double", rules) == []
    assert messages(spark, [(-5.0,)], "a double", value_range("a", high=10.0)) == []
    assert messages(spark, [(1.0,)], "b double", value_range("a", low=0.0)) == [
        "t: missing required column 'a'"
    ]


def test_uniqueness_counts_null_keys(spark):
    rule = [UniqueRatio(columns=("a", "b"), threshold=0.75)]
    assert messages(spark, [(1, None), (None, 1), (2, 2), (2, 2)], "a int, b int", rule) == []
    assert messages(spark, [(1, None), (1, None), (2, 2), (2, 2)], "a int, b int", rule) == [
        "t: uniqueness ratio 0.500 < 0.750 for ['a', 'b']"
    ]
    assert messages(spark, [], "a int, b int", rule) == ["t: cannot evaluate uniqueness on empty table"]
    assert messages(spark, [(1,)], "b int", rule) == ["t: missing uniqueness key columns ['a']"]


def test_report_and_gate(spark):
    rules = {"x": [NonEmpty()], "y": [NonEmpty(), NotNullRate(columns=("a",), threshold=1.0)]}
    full = spark.createDataFrame([(1,)], "a int")
    good = quality_report(spark, {"x": full, "y": full}, rules)
    require_quality(good)
    assert [r.rule for r in good.orderBy("rule").collect()] == [1, 2, 3]
    bad = quality_report(spark, {"x": None, "y": full.filter("a > 1")}, rules)
    with pytest.raises(RuntimeError, match="x: missing table; y: row count is zero; y: cannot"):
        require_quality(bad)


def test_rules_share_a_pass_and_keys_travel_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id as a", "id as b", "id as c").write.parquet(path)
    rules = [
        NonEmpty(),
        NotNullRate(columns=("a",)),
        UniqueRatio(columns=("a", "c")),
        *value_range("b", 0.0, 5.0),
    ]
    report = check_table(spark.read.parquet(path), "t", rules)
    assert [r.rule for r in report.orderBy("rule").collect()] == [1, 2, 3, 4, 5]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<(.*?)>", plan) == ["a:bigint,b:bigint", "a:bigint,c:bigint"]


def test_a_missing_column_is_reported_once(spark):
    df = spark.range(1)
    for low, high in ((0.0, 1.0), (None, None), (None, 1.0)):
        report = check_table(df, "t", value_range("gone", low, high))
        messages = [r.message for r in report.collect() if r.message]
        assert messages == ["t: missing required column 'gone'"]


def test_names_may_hold_any_character(spark):
    df = spark.range(1).selectExpr("-1 as `p%d`")
    (row,) = check_table(df, "t%s", value_range("p%d", low=0.0)).collect()
    assert row.message == "t%s: column 'p%d' min -1 < 0.0"


def _bucketed(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vendor int, at string, amount double, feed string")
    df = df.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("day", F.to_date("at"))
    name = f"t_{uuid.uuid4().hex}"
    return df, name, buckets.write_buckets(df, name, f"{tmp_path}/{name}", ["day", "feed"], ["vendor", "at"], 4)


def test_keys_in_buckets_are_counted_without_an_exchange(spark, tmp_path):
    rows = [(v, f"2024-0{m}-1{d} 08:00:0{v}", a, f) for v in range(5) for m in (1, 2) for d in (1, 2) for a in (0.0, -0.0, 1.5)
            for f in ("x", "y")]
    rows += [(None, None, None, "x"), (None, None, float("nan"), "y"), (1, None, float("nan"), "x"), (1, None, float("nan"), "y")]
    df, name, table = _bucketed(spark, tmp_path, rows)
    rules = [UniqueRatio(columns=("vendor", "at", "amount"), threshold=0.9), UniqueRatio(columns=("at", "vendor"), threshold=0.1)]
    months = buckets.month_slices(list_partitions(spark, f"{tmp_path}/{name}"), "day")
    assert len(months) == 3
    expected = sorted(map(tuple, check_table(df, "t", rules).collect()))
    assert expected[0][3] == (2 * 20 + 3) / len(rows)
    for apart in (months, ()):
        report = check_table(table, "t", rules, apart=apart)
        assert sorted(map(tuple, report.collect())) == expected
        plan = report._jdf.queryExecution().sparkPlan().toString()
        assert "Bucketed: true" in plan
        physical = report._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in physical
    # a month's scan opens its own partitions only
    one = table.where(months[0])
    assert {f.split("day=")[1][:7] for f in one.inputFiles()} == {"2024-01"}


def test_buckets_of_replaced_partitions(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 1.0, "x"), (2, "2024-01-02 01:00:00", 1.0, "x")]
    df, name, _ = _bucketed(spark, tmp_path, rows)
    new = df.where("vendor = 2").withColumn("amount", F.lit(7.0))
    table = buckets.write_buckets(new, name, f"{tmp_path}/{name}", ["day", "feed"], ["vendor", "at"], 4, "partitions")
    assert {(r.vendor, r.amount) for r in table.collect()} == {(1, 1.0), (2, 7.0)}
    with pytest.raises(ValueError, match="amount"):
        buckets.write_buckets(df, "never", f"{tmp_path}/never", ["day"], ["amount"], 4)
