from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyfare import schemas
from skyfare.plans import jobs
from skyfare.registry import inputs
from skyfare.sources import tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landing_zone(spark, tmp_path_factory):
    zone = jobs.Layout(str(tmp_path_factory.mktemp("zone")))
    inputs.write_ride_months(spark, SF_DIR, zone.raw_trips)
    inputs.write_documents(inputs.reading_documents(spark, SF_DIR), zone.raw_readings)
    return zone


def run(spark, layout, zone, **more):
    return jobs.run_pipeline(
        spark,
        layout,
        landing_trips=zone.raw_trips,
        landing_readings=zone.raw_readings,
        taxi_type="yellow",
        start_month="2024-01",
        end_month="2024-01",
        start_date="2024-01-01",
        end_date="2024-01-05",
        today="2024-01-04",
        **more,
    )


def test_steps_run_in_order_and_again(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    assert run(spark, layout, landing_zone) == list(jobs.STEPS)
    first = tables.scan_layer(spark, layout.daily, schemas.DAILY).orderBy("date").collect()
    assert sum(r.avg_temp is not None for r in first) <= 4  # four days of weather landed
    assert run(spark, layout, landing_zone, skip_steps=["bronze_tlc", "quality"]) == [
        "bronze_weather",
        "silver_trips",
        "silver_weather",
        "silver_enriched",
        "gold_daily_metrics",
    ]
    again = tables.scan_layer(spark, layout.daily, schemas.DAILY).orderBy("date").collect()
    assert [r.total_trips for r in again] == [r.total_trips for r in first]


def test_raw_documents_of_another_tool(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    run(spark, layout, landing_zone, skip_steps=["bronze_weather", *jobs.STEPS[3:]])
    inputs.write_documents(inputs.reading_documents(spark, SF_DIR), layout.raw_readings)
    run(spark, layout, landing_zone, skip_steps=jobs.STEPS[:3], raw_readings_format="json")
    assert not tables.scan_layer(spark, layout.daily, schemas.DAILY).isEmpty()


def test_enriched_table_does_not_fan_out(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips)
    documents = tables.scan_reading_documents(spark, landing_zone.raw_readings)
    jobs.build_readings(spark, documents.unionAll(documents), layout.readings)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched)
    trips = tables.scan_layer(spark, layout.trips, schemas.TRIPS)
    enriched = tables.scan_layer(spark, layout.enriched, schemas.ENRICHED)
    assert enriched.count() == trips.count() > 0


def test_rebuilding_one_feed(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))

    def types():
        return {r.taxi_type for r in tables.scan_layer(spark, layout.trips, schemas.TRIPS).select("taxi_type").distinct().collect()}

    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips)
    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips, ["green"], replace="partitions")
    assert types() == {"yellow", "green", "hired"}
    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips, ["green"])
    assert types() == {"green"}


def test_rebuilding_a_window_of_days(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips)
    documents = tables.scan_reading_documents(spark, landing_zone.raw_readings)
    jobs.build_readings(spark, documents, layout.readings)

    def build(*window, replace="table"):
        jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched, *window, replace=replace)
        jobs.build_daily(spark, layout.enriched, layout.daily, *window, replace=replace)
        return [tuple(r) for r in _map_free(tables.scan_layer(spark, layout.daily, schemas.DAILY))]

    whole = build()
    days = [r[-1] for r in whole]
    window = (days[3].isoformat(), days[5].isoformat())
    assert build(*window, replace="partitions") == whole
    assert build(*window) == whole[3:6]
    with pytest.raises(ValueError, match="all months"):
        jobs.build_trips(spark, landing_zone.raw_trips, layout.trips, None, "2024-01", None, "partitions")


def test_incremental_run_keeps_feeds_and_drops_empty_days(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path / "tables"))
    jobs.build_trips(spark, landing_zone.raw_trips, layout.trips)
    documents = tables.scan_reading_documents(spark, landing_zone.raw_readings)
    jobs.build_readings(spark, documents, layout.readings)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched)
    jobs.build_daily(spark, layout.enriched, layout.daily)

    def counts():
        return {
            (str(r.pickup_date), r.taxi_type): r["count"]
            for r in tables.scan_layer(spark, layout.trips, schemas.TRIPS).groupBy("pickup_date", "taxi_type").count().collect()
        }

    before = counts()
    lost = "2024-01-03"
    others = {k: n for k, n in before.items() if k[0] != lost}
    raw = inputs.write_ride_months(spark, SF_DIR, str(tmp_path / "changed"), without=lost)
    window = {"replace": "partitions", "first_day": "2024-01-02", "last_day": "2024-01-04"}

    # one feed: the others keep the day
    jobs.build_trips(spark, raw, layout.trips, ["yellow"], **window)
    assert counts() == {k: n for k, n in before.items() if k != (lost, "yellow")}

    # all feeds: the day leaves every table
    jobs.build_trips(spark, raw, layout.trips, **window)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched, **window)
    jobs.build_daily(spark, layout.enriched, layout.daily, **window)
    assert counts() == others
    days = {k[0] for k in others}
    enriched = tables.scan_layer(spark, layout.enriched, schemas.ENRICHED)
    assert {str(r.pickup_date) for r in enriched.select("pickup_date").distinct().collect()} == days
    daily = tables.scan_layer(spark, layout.daily, schemas.DAILY).collect()
    assert {str(r.date): r.total_trips for r in daily} == {d: sum(n for k, n in others.items() if k[0] == d) for d in days}


def test_incremental_run_of_all_steps(spark, landing_zone, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    run(spark, layout, landing_zone)
    whole = _map_free(tables.scan_layer(spark, layout.daily, schemas.DAILY))
    run(spark, layout, landing_zone, replace="partitions", first_day="2024-01-02", last_day="2024-01-03")
    assert _map_free(tables.scan_layer(spark, layout.daily, schemas.DAILY)) == whole
    with pytest.raises(ValueError, match="window"):
        run(spark, layout, landing_zone, first_day="2024-01-02")


def _map_free(daily):
    counts = F.array_sort(F.map_entries("payment_type_counts")).cast("string")
    rounded = [F.round(c, 6).alias(c) for c in ("avg_fare_amount", "surge_proxy", "avg_temp", "total_precip")]
    return daily.select("total_trips", *rounded, counts, "date").orderBy("date").collect()


def test_gate_stops_the_run(spark, landing_zone, tmp_path):
    with pytest.raises(RuntimeError, match="silver.trips: missing table; silver.enriched_trips: missing table"):
        run(spark, jobs.Layout(str(tmp_path)), landing_zone, skip_steps=jobs.STEPS[:-1])


def test_missing_inputs(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        jobs.build_trips(spark, layout.raw_trips, layout.trips)
    with pytest.raises(FileNotFoundError):
        run(spark, layout, layout, skip_steps=[s for s in jobs.STEPS if s != "silver_weather"])
    empty = spark.createDataFrame([], schemas.READING_DOCUMENT)
    with pytest.raises(FileNotFoundError):
        jobs.build_readings(spark, empty, layout.readings)
    with pytest.raises(ValueError, match="unknown steps"):
        run(spark, layout, layout, skip_steps=["silver"])


def test_feed_without_required_column(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    month = f"{layout.raw_trips}/taxi_type=yellow/year=2024/month=01"
    spark.range(3).withColumn("fare_amount", F.lit(1.0)).write.parquet(month)
    with pytest.raises(ValueError, match="trip_distance"):
        jobs.build_trips(spark, layout.raw_trips, layout.trips)
