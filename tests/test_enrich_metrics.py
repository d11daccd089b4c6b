from __future__ import annotations

from collections import Counter, defaultdict
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyfare.operators import metrics
from skyfare.operators.enrich import broadcast_fits, enrich_trips

DAY = date(2024, 1, 1)
WEATHER = "date date, hour bigint, temperature_2m double, precipitation double, windspeed_10m double"
TRIPS = "pickup_date date, pickup_hour bigint, fare_amount double, total_amount double, trip_distance double"
ENRICHED = TRIPS + ", payment_type bigint, temperature_2m double, precipitation double"


def test_left_join_keeps_unmatched_trips(spark):
    """Hours 7 to 9 of two days: the middle hour has no reading, the second day only that one."""
    following = date(2024, 1, 2)
    trips = spark.createDataFrame([(d, h, 6.5, 9.0, 1.25) for d in (DAY, following) for h in (7, 8, 9)], TRIPS)
    weather = spark.createDataFrame(
        [(DAY, 7, -3.0, None, 4.0), (DAY, 9, 1.5, 0.75, 0.0), (following, 8, 2.0, 0.0, 6.0)], WEATHER
    )
    rows = enrich_trips(trips, weather).orderBy("pickup_date", "pickup_hour").collect()
    assert [r.temperature_2m for r in rows] == [-3.0, None, 1.5, None, 2.0, None]
    assert [r.precipitation for r in rows] == [None, None, 0.75, None, 0.0, None]


@pytest.mark.parametrize("broadcast_readings", [True, False])
def test_trips_may_hold_a_map(spark, broadcast_readings):
    trips = spark.createDataFrame([(DAY, 7, 1.0, 1.0, 1.0)], TRIPS).selectExpr("*", "map('a', 1) AS extras")
    weather = spark.createDataFrame([(DAY, 7, 4.0, 0.0, 2.0)], WEATHER)
    (row,) = enrich_trips(trips, weather, broadcast_readings).collect()
    assert (row.extras, row.temperature_2m) == ({"a": 1}, 4.0)


@pytest.mark.parametrize("broadcast_readings", [None, True, False])
def test_join_paths_agree(spark, broadcast_readings):
    """A hot hour, a repeated reading, NULL keys: each trip comes out once on every path."""
    hours = [0] * 60 + [1, 2, None] * 10
    trips = spark.createDataFrame(
        [(None if i % 7 == 6 else DAY, h, 1.0, float(i % 5), 2.0) for i, h in enumerate(hours)], TRIPS
    )
    weather = spark.createDataFrame(
        [(DAY, 0, 5.0, 0.2, 10.0), (DAY, 0, 4.0, 0.9, 11.0), (DAY, 1, 6.0, None, 12.0), (None, None, 1.0, 1.0, 1.0)],
        WEATHER,
    )
    joined = enrich_trips(trips, weather, broadcast_readings)
    got = Counter((r.pickup_date, r.pickup_hour, r.total_amount, r.temperature_2m, r.precipitation) for r in joined.collect())
    reading = {(DAY, 0): (4.0, 0.9), (DAY, 1): (6.0, None)}
    expected = Counter(
        (t.pickup_date, t.pickup_hour, t.total_amount, *reading.get((t.pickup_date, t.pickup_hour), (None, None)))
        for t in trips.collect()
    )
    assert got == expected
    assert joined.columns == [*trips.columns, "temperature_2m", "precipitation", "windspeed_10m"]


def test_broadcast_is_bounded_by_distinct_hours(spark):
    weather = spark.createDataFrame([(DAY, h % 3, 1.0, 1.0, 1.0) for h in range(30)], WEATHER)
    assert broadcast_fits(weather, 3)
    assert not broadcast_fits(weather, 2)


def test_daily_metrics_expected_values(spark):
    """Two trips share an hour and its rain, one has no distance, and a second day stands apart."""
    following = date(2024, 1, 2)
    enriched = spark.createDataFrame(
        [
            (DAY, 7, 5.0, 8.0, 4.0, 3, 6.0, 0.5),
            (DAY, 7, 7.0, 9.0, 0.0, None, 6.0, 0.5),
            (DAY, 8, None, 1.0, 2.0, 3, -2.0, None),
            (following, 23, 2.0, 3.0, 12.0, 4, None, 0.25),
        ],
        ENRICHED,
    )
    first, second = metrics.daily_metrics(enriched).orderBy("date").collect()
    assert first.asDict() == {
        "date": DAY,
        "total_trips": 3,
        "avg_fare_amount": 6.0,
        "avg_total_amount": 6.0,
        "avg_trip_distance": 2.0,
        "surge_proxy": pytest.approx((2.0 + 90.0 + 0.5) / 3),
        "avg_temp": 2.0,
        "total_precip": 0.5,
        "payment_type_counts": {"3": 2},
    }
    assert tuple(second) == (following, 1, 2.0, 3.0, 12.0, 0.25, None, 0.25, {"4": 1})


def test_day_without_weather_or_payment(spark):
    enriched = spark.createDataFrame([(DAY, 0, None, 12.0, None, None, None, None)], ENRICHED)
    (row,) = metrics.daily_metrics(enriched).collect()
    assert (row.avg_temp, row.total_precip, row.payment_type_counts) == (None, 0.0, None)
    assert (row.avg_fare_amount, row.avg_trip_distance) == (None, None)
    assert row.surge_proxy == pytest.approx(120.0)  # no distance counts as the shortest


def test_feed_without_payment_column(spark):
    enriched = spark.createDataFrame([(DAY, 0, 1.0, 2.0, 3.0, 1, 4.0, 5.0)], ENRICHED).drop("payment_type")
    days = metrics.daily_metrics(enriched)
    assert days.schema["payment_type_counts"].dataType.simpleString() == "map<string,bigint>"
    assert days.first().payment_type_counts is None


value = st.none() | st.sampled_from([0.0, 0.05, 1.25, 8.0])
enriched_rows = st.lists(
    st.tuples(
        st.sampled_from([None, DAY, date(2024, 1, 2)]),
        st.sampled_from([None, 0, 1]),
        value,
        value,
        value,
        st.sampled_from([None, 1, 2]),
        value,
        value,
    ),
    max_size=30,
)


def brute_force(rows):
    def mean(values):
        values = [v for v in values if v is not None]
        return sum(values) / len(values) if values else None

    days = defaultdict(list)
    for r in rows:
        days[r[0]].append(r)
    result = {}
    for day, trips in days.items():
        ratios = [
            None if t[3] is None else t[3] / max(t[4] if t[4] is not None else 0.1, 0.1) for t in trips
        ]
        hours = defaultdict(list)
        for t in trips:
            hours[t[1]].append((t[6], t[7]))
        nulls_first = lambda p: [(x is not None, x if x is not None else 0) for x in p]
        chosen = [min(readings, key=nulls_first) for readings in hours.values()]
        payments = Counter(str(t[5]) for t in trips if t[5] is not None)
        dated = day is not None
        result[day] = (
            len(trips),
            mean(t[2] for t in trips),
            mean(t[3] for t in trips),
            mean(t[4] for t in trips),
            mean(ratios),
            mean(c[0] for c in chosen) if dated else None,
            sum(c[1] or 0.0 for c in chosen) if dated else None,
            dict(payments) or None if dated else None,
        )
    return result


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(enriched_rows)
def test_daily_metrics_equal_brute_force(spark, data):
    df = spark.createDataFrame(data, ENRICHED).repartition(3)
    got = {r.date: tuple(r)[1:] for r in metrics.daily_metrics(df).collect()}
    expected = brute_force(data)
    assert got.keys() == expected.keys()
    for day, row in expected.items():
        for a, b in zip(got[day], row):
            assert a == (pytest.approx(b) if isinstance(b, float) else b)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(enriched_rows)
def test_one_pass_equals_separate_aggregates(spark, data):
    df = spark.createDataFrame(data, ENRICHED).filter("pickup_date is not null")
    parts = (
        metrics.daily_trip_metrics(df)
        .join(metrics.daily_readings(df), "pickup_date", "left")
        .join(metrics.payment_map(metrics.payment_counts(df)), "pickup_date", "left")
        .withColumnRenamed("pickup_date", "date")
    )
    whole = {r.date: r.asDict() for r in metrics.daily_metrics(df).collect()}
    for r in parts.collect():
        for name, x in r.asDict().items():
            assert whole[r.date][name] == (pytest.approx(x) if isinstance(x, float) else x)
