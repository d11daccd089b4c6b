from __future__ import annotations

from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.functions.parsing import READING_TIME_FORMATS, tolerant_cast, wall_clock
from skyfare.operators import conform
from skyfare.operators.dedupe import keep_one
from skyfare.schemas import TRIP_FIELDS

RAW = (
    "VendorID bigint, tpep_pickup_datetime string, tpep_dropoff_datetime string, "
    "PULocationID bigint, DOLocationID bigint, trip_distance double, fare_amount double, "
    "total_amount double, payment_type bigint"
)


def raw_trip(**changes):
    trip = {
        "VendorID": 6,
        "tpep_pickup_datetime": "2023-11-30 22:58:30",
        "tpep_dropoff_datetime": "2023-12-01 00:03:05",
        "PULocationID": 132,
        "DOLocationID": 7,
        "trip_distance": 17.25,
        "fare_amount": 61.5,
        "total_amount": 80.25,
        "payment_type": 4,
    }
    return {**trip, **changes}


def raw(spark, *trips):
    return spark.createDataFrame([tuple(t.values()) for t in trips], RAW)


def test_copies_and_negative_fares_go(spark):
    """A trip over midnight, a copy that differs outside the key, and one of no length beside a refund."""
    standing = {"VendorID": 3, "tpep_dropoff_datetime": "2023-11-30 22:58:30", "trip_distance": 0.0}
    df = raw(
        spark,
        raw_trip(),
        raw_trip(trip_distance=18.0, payment_type=2),
        raw_trip(**standing),
        raw_trip(**standing, fare_amount=-61.5, total_amount=-80.25),
    )
    still, moved = sorted(conform.clean_trips(df, "yellow").collect(), key=lambda r: r.vendor_id)
    assert (moved.pickup_hour, moved.taxi_type, moved.passenger_count) == (22, "yellow", None)
    assert moved.dropoff_datetime == datetime(2023, 12, 1, 0, 3, 5)
    assert str(moved.pickup_date) == "2023-11-30"
    assert (moved.trip_distance, moved.payment_type) == (17.25, 4)  # the smaller of the copies
    assert (still.vendor_id, still.trip_distance, still.total_amount) == (3, 0.0, 80.25)


def test_clean_trips_boundaries(spark):
    df = raw(
        spark,
        raw_trip(VendorID=1, tpep_dropoff_datetime="2023-11-30 22:58:30"),  # zero length stays
        raw_trip(VendorID=2, tpep_dropoff_datetime="2023-11-30 22:58:29"),
        raw_trip(VendorID=3, trip_distance=0.0, fare_amount=0.0),
        raw_trip(VendorID=4, trip_distance=None),
        raw_trip(VendorID=5, fare_amount=None),
        raw_trip(VendorID=6, total_amount=-5.0),  # the total is not checked
        raw_trip(VendorID=7, fare_amount=float("nan")),
        raw_trip(VendorID=8, tpep_pickup_datetime="garbage"),
        raw_trip(VendorID=9, tpep_dropoff_datetime=None),
    )
    kept = {r.vendor_id for r in conform.clean_trips(df, "yellow").collect()}
    assert kept == {1, 3, 6, 7}


def test_first_existing_name_wins_even_if_all_null(spark):
    df = spark.createDataFrame(
        [(None, 7, "2024-01-01 05:00:00")], "vendorID int, vendor_id int, PICKUP_DATETIME string"
    )
    row = conform.conform_trips(df, "green").first()
    assert row.vendor_id is None
    assert row.pickup_datetime == datetime(2024, 1, 1, 5)


def test_conformed_schema_is_fixed(spark):
    df = conform.conform_trips(spark.createDataFrame([(1,)], "unrelated int"), "green")
    assert [(f.name, f.dataType) for f in df.schema[:-1]] == [(f.name, f.type) for f in TRIP_FIELDS]
    assert df.schema[-1].name == "taxi_type"
    assert conform.missing_required(df.select("vendor_id")) == [
        "pickup_datetime",
        "dropoff_datetime",
        "trip_distance",
        "fare_amount",
    ]


def test_absent_filter_column_drops_all_rows(spark):
    df = raw(spark, raw_trip()).drop("fare_amount")
    assert conform.clean_trips(df, "yellow").isEmpty()


def test_values_that_do_not_fit_become_null(spark):
    df = spark.createDataFrame([("12",), ("12.7",), ("x",), (None,), ("99999999999",)], "v string")
    got = df.select(tolerant_cast(F.col("v"), T.StringType(), T.IntegerType()).alias("v"))
    assert [r.v for r in got.collect()] == [12, 12, None, None, None]
    wide = spark.createDataFrame([(2**40,), (5,)], "v bigint")
    got = wide.select(tolerant_cast(F.col("v"), T.LongType(), T.IntegerType()).alias("v"))
    assert [r.v for r in got.collect()] == [None, 5]


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, passenger_count double")
    b = spark.createDataFrame([(3,)], "id int")
    assert sorted(map(tuple, conform.union_feeds([a, b]).collect())) == [(1, 2.0), (3, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_wall_clock_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on this day
        df = spark.createDataFrame(
            [("2024-03-10 02:30:00",), ("2024-03-10T02:30",), ("2024-03-10T02:30:00",), ("n/a",), (None,)],
            "t string",
        )
        parsed = wall_clock(F.col("t"), T.StringType(), READING_TIME_FORMATS)
        got = [r.v for r in df.select(parsed.alias("v")).collect()]
        assert got == [datetime(2024, 3, 10, 2, 30)] * 3 + [None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_instants_show_the_session_clock(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-01-01T05:00:00Z",)], "t string")
        row = df.select(
            wall_clock(F.col("t"), T.StringType()).alias("text"),
            wall_clock(F.col("t").cast("timestamp"), T.TimestampType()).alias("zoned"),
            wall_clock(F.lit(1704085200), T.LongType()).alias("epoch"),
        ).first()
        assert list(row) == [datetime(2024, 1, 1, 0, 0)] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


rows = st.lists(
    st.tuples(
        st.sampled_from([None, 1, 2]),
        st.sampled_from([None, "a", "b"]),
        st.sampled_from([None, 0.0, 1.5, 2.5]),
        st.sampled_from([None, 3, 4]),
    ),
    max_size=25,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows)
def test_keep_one_equals_brute_force(spark, data):
    df = spark.createDataFrame(data, "k1 int, k2 string, v double, w int").repartition(3)
    groups = defaultdict(list)
    for k1, k2, v, w in data:
        groups[k1, k2].append((v, w))
    nulls_first = lambda r: [(x is not None, x if x is not None else 0) for x in r]
    expected = {(*k, *min(g, key=nulls_first)) for k, g in groups.items()}
    got = [tuple(r) for r in keep_one(df, ["k1", "k2"]).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_keep_one_on_keys_alone(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert sorted(map(str, keep_one(df, ["k"]).collect())) == ["Row(k=1)", "Row(k=None)"]


def test_dedupe_keeps_feeds_apart(spark):
    a = conform.conform_trips(raw(spark, raw_trip()), "yellow")
    b = conform.conform_trips(raw(spark, raw_trip(), raw_trip()), "green")
    both = conform.dedupe_trips(conform.union_feeds([a, b]))
    assert sorted(r.taxi_type for r in both.collect()) == ["green", "yellow"]


def test_text_without_a_date_is_null(spark):
    times = spark.createDataFrame([("12:30",), ("T08:00:00",), (" 7:05 ",), ("2024-01-01 07:05",)], "t string")
    read = times.select(wall_clock(F.col("t"), T.StringType(), ("HH:mm",)[:0]).cast("string").alias("t"))
    assert [r.t for r in read.collect()] == [None, None, None, "2024-01-01 07:05:00"]
