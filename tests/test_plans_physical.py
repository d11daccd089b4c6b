"""The shape of the physical plans: what keeps the jobs fast when the data grows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skyfare.operators import conform, enrich, metrics
from skyfare.registry import inputs
from skyfare.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/raw/taxi_type=yellow/year=2024/month=01"
    inputs.ride_feeds(spark, SF_DIR)["yellow"].withColumn("extra", F.lit("x")).write.parquet(path)
    (frame,) = tables.scan_raw_trips(spark, f"{tmp_path}/raw")
    text = plan(conform.clean_trips(frame, F.col("taxi_type")))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(trip_distance,0.0)" in pushed
    assert "GreaterThanOrEqual(fare_amount" in pushed
    assert "IsNotNull(tpep_pickup_datetime)" in pushed
    assert "extra" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_metrics_scan_the_trips_once(spark, tmp_path):
    path = str(tmp_path / "enriched")
    trips, readings = inputs.hourly_trips(spark, SF_DIR), inputs.hourly_readings(spark, SF_DIR)
    enrich.enrich_trips(trips, readings).write.parquet(path)
    text = plan(metrics.daily_metrics(spark.read.parquet(path)))
    assert text.count("FileScan") == 1
    # combined before the first shuffle, by hashing
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in below and "SortAggregate" not in below


def test_broadcast_join_leaves_the_trips_in_place(spark):
    trips, readings = inputs.hourly_trips(spark, SF_DIR), inputs.hourly_readings(spark, SF_DIR)
    text = plan(enrich.enrich_trips(trips, readings, broadcast_readings=True))
    assert "BroadcastHashJoin" in text
    trip_side = text[text.index("BroadcastHashJoin") : text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in trip_side


def test_copies_of_a_trip_combine_before_the_shuffle(spark):
    trips = conform.conform_trips(inputs.rides(spark, SF_DIR), F.col("taxi_type"))
    text = plan(conform.dedupe_trips(trips))
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search("WindowGroupLimit.*Partial", text[text.index("Exchange hashpartitioning") :])
