"""Zone maps, footers read in tasks, rules measured on the write, hours spread by their counts."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skyfare import schemas
from skyfare.operators import enrich, quality
from skyfare.plans import jobs
from skyfare.registry import inputs
from skyfare.sources import footers, landing, tables, zones
from skyfare.sources.files import list_files

SF_DIR = "/root/testdata/sf0.001"


def write_months(spark, root, months, per_month=6, pickup="tpep_pickup_datetime"):
    """One file for each month of a feed, trips on its first days."""
    rows = spark.range(months * per_month).select(
        F.expr(f"add_months(date'2020-01-01', cast(id div {per_month} as int))").alias("first"), "id"
    )
    start = F.expr(f"cast(first as timestamp_ntz) + make_dt_interval(cast(id % {per_month} as int), 8)")
    trips = rows.select(
        start.alias(pickup),
        (start + F.expr("interval 9 minutes")).alias(pickup.replace("pickup", "dropoff")),
        F.lit(1).alias("VendorID"),
        F.col("id").cast("int").alias("PULocationID"),
        F.lit(7).alias("DOLocationID"),
        F.lit(1.0).alias("passenger_count"),
        F.lit(2.5).alias("trip_distance"),
        F.lit(11.0).alias("fare_amount"),
        F.col("id").cast("double").alias("total_amount"),
        F.lit(1).alias("payment_type"),
        F.lit("yellow").alias("taxi_type"),
        F.date_format("first", "yyyy").alias("year"),
        F.date_format("first", "MM").alias("month"),
    )
    trips.repartition("year", "month").write.mode("append").partitionBy("taxi_type", "year", "month").parquet(root)


def jobs_of(spark, work):
    """What ``work`` returns and how many Spark jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def opened(frames):
    return [f for frame in frames for f in frame.inputFiles()]


def window_frames(spark, root, first, last):
    return tables.scan_units(spark, root, zones.files_of_window(spark, root, first, last), by_file=True)


def test_a_window_opens_only_files_that_meet_it(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_months(spark, root, 48)
    # a late file of another month holds two trips of the window
    late = spark.read.parquet(f"{root}/taxi_type=yellow/year=2021/month=05").limit(2)
    late.write.mode("append").parquet(f"{root}/taxi_type=yellow/year=2023/month=12")
    assert len(opened(window_frames(spark, root, "2021-05-02", "2021-05-04"))) == 49
    assert zones.measure_zones(spark, root) == 49 and zones.measure_zones(spark, root) == 0
    found = opened(window_frames(spark, root, "2021-05-02", "2021-05-04"))
    places = sorted(f.split("year=")[1].rsplit("/", 1)[0] for f in found)
    assert places in (["2021/month=05"], ["2021/month=05", "2023/month=12"])
    first = spark.read.parquet(*[f for f in found if "2023" in f]) if len(found) > 1 else None
    assert first is None or first.count() == 2
    assert len(opened(window_frames(spark, root, "2021-05-01", "2021-05-01"))) == 2
    # months without trips in the window: nothing is opened
    assert window_frames(spark, root, "2021-05-20", "2021-05-22") == []
    assert len(opened(window_frames(spark, root, "2023-11-30", None))) == 1
    # zones are no raw files
    assert list_files(spark, root).count() == 49
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{root}/none")


def test_a_window_is_built_from_the_files_that_meet_it(spark, tmp_path):
    root, target = str(tmp_path / "raw"), str(tmp_path / "trips")
    write_months(spark, root, 5)
    landed = str(tmp_path / "landed")
    assert len(landing.land_missing_months(spark, root, landed, "yellow", "2020-01", "2020-05")) == 5
    assert zones.zone_map(spark, landed).count() == 5

    def days():
        return [str(r.pickup_date) for r in tables.scan_layer(spark, target, schemas.TRIPS).select("pickup_date").distinct().orderBy("pickup_date").collect()]

    jobs.build_trips(spark, landed, target)
    before = days()
    # files that no window meets are not opened, even if they are no Parquet files any more
    for file in Path(landed).glob("taxi_type=yellow/year=2020/month=04/*.parquet"):
        size, at = file.stat().st_size, file.stat().st_mtime_ns
        file.write_bytes(b"x" * size)
        os.utime(file, ns=(at, at))
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    window = {"replace": "partitions", "first_day": "2020-02-02", "last_day": "2020-02-20"}
    jobs.build_trips(spark, landed, target, **window)
    assert days() == before
    # a window without any file left empties its days
    for file in Path(landed).glob("taxi_type=yellow/year=2020/month=02/*"):
        file.unlink()
    jobs.build_trips(spark, landed, target, **window)
    assert days() == [d for d in before if not "2020-02-02" <= d <= "2020-02-20"]


def test_a_replaced_file_has_no_zone(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_months(spark, root, 2)
    zones.measure_zones(spark, root)
    (file,) = Path(root).glob("taxi_type=yellow/year=2020/month=01/*.parquet")
    os.utime(file, (1, 1))
    assert len(opened(window_frames(spark, root, "2020-02-01", "2020-02-02"))) == 2
    assert zones.measure_zones(spark, root) == 1
    assert len(opened(window_frames(spark, root, "2020-02-01", "2020-02-02"))) == 1


def test_zones_of_odd_files(spark, tmp_path):
    root = str(tmp_path / "raw")
    month = f"{root}/taxi_type=a b%/year=2020/month=0"
    spark.sql("select cast(null as timestamp_ntz) pickup_datetime, 1 x").write.parquet(f"{month}1")
    spark.sql("select '2020-03-04 05:06:07' pickup_datetime").write.parquet(f"{month}2")
    spark.sql("select 1 x").write.parquet(f"{month}3")
    spark.sql("select '2020-03-04 05:06:07' pickup_datetime where false").coalesce(1).write.parquet(f"{month}4")
    assert zones.files_of_window(spark, str(tmp_path / "none"), None, None) is None
    assert zones.measure_zones(spark, str(tmp_path / "none")) == 0
    assert zones.measure_zones(spark, root) == 4
    found = {r.path.split("month=")[1][:2]: (str(r.first_pickup), r.rows) for r in zones.zone_map(spark, root).collect()}
    assert found == {"01": ("None", 1), "02": ("2020-03-04 05:06:07", 1), "03": ("None", 1), "04": ("None", None)}
    assert [r.path.split("month=")[1][:2] for r in zones.files_of_window(spark, root, None, "2020-04-01").collect()] == ["02"]
    assert zones.files_of_window(spark, root, "2020-04-01", None).count() == 0


def test_jobs_to_find_schemas_do_not_grow_with_the_files(spark, tmp_path):
    counts = []
    for months in (3, 30):
        root = str(tmp_path / f"raw{months}")
        write_months(spark, root, months)
        other = spark.read.parquet(f"{root}/taxi_type=yellow/year=2020/month=01")
        other.withColumn("PULocationID", F.col("PULocationID").cast("long")).write.mode("append").parquet(
            f"{root}/taxi_type=yellow/year=2020/month=03"
        )
        frames, number = jobs_of(spark, lambda root=root: tables.scan_raw_trips(spark, root))
        # the month with two types is read by file
        assert sorted(f.count() for f in frames) == [6, 6 * months]
        counts.append(number)
    assert counts[0] == counts[1]


def test_footers_that_tasks_cannot_open_are_left_to_spark(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "raw")
    write_months(spark, root, 2)
    files = list_files(spark, root)
    expected = footers.schema_groups(spark, files)
    closed = files.withColumn("path", F.regexp_replace("path", "^file:", "closed:"))
    monkeypatch.setattr(footers, "file_signatures", lambda found, number: found.select("directory", "path", F.lit(None).cast("string").alias("signature")))
    assert footers.schema_groups(spark, closed) == expected
    assert footers._signature("closed:/x") is None and footers._signature(str(tmp_path / "none")) is None


def test_rules_are_measured_as_tables_are_written(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips)
    inputs.write_documents(inputs.reading_documents(spark, SF_DIR), layout.raw_readings)
    measured = {name: quality.Measured(name) for name in quality.STANDARD_RULES}
    jobs.build_trips(spark, layout.raw_trips, layout.trips, measured=measured["silver.trips"])
    jobs.build_readings(spark, tables.scan_reading_documents(spark, layout.raw_readings), layout.readings)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched, measured=measured["silver.enriched_trips"])
    jobs.build_daily(spark, layout.enriched, layout.daily, measured=measured["gold.daily_metrics"])
    scanned = jobs.check_layers(spark, layout).orderBy("rule").collect()
    report = jobs.check_layers(spark, layout, measured)
    assert report.orderBy("rule").collect() == scanned
    # one read is left, that of the uniqueness rule
    text = report._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "silver/trips" in text
    one = measured["gold.daily_metrics"].report(spark, tables.scan_if_exists(spark, layout.daily))
    assert "FileScan" not in one._jdf.queryExecution().executedPlan().toString()


def test_heavy_hours_spread_by_their_own_counts(spark):
    trips = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-02")).when(F.col("id") % 3 == 1, F.date_add(F.lit("2024-02-01"), (F.col("id") % 40).cast("int")).cast("string")).cast("date").alias("pickup_date"),
        F.when(F.col("id") % 3 == 0, 5).otherwise((F.col("id") % 7).cast("int")).alias("pickup_hour"),
        "id",
    )
    heavy = enrich.heavy_hours(trips, 300)
    assert [tuple(map(str, r)) for r in heavy.collect()] == [("2024-01-02", "5", "4")]
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-03-20").cast("date")))
    readings = spark.range(24).select(F.col("id").cast("int").alias("hour"), days.alias("date")).withColumns(
        {"temperature_2m": F.col("hour") * 1.0, "precipitation": F.dayofyear("date") * 1.0, "windspeed_10m": F.lit(0.0)}
    )
    hourly = readings.withColumnsRenamed({"date": "_date", "hour": "_hour"})
    # the reading of the heavy hour four times, no other twice
    assert enrich.copied_readings(hourly, heavy).count() == readings.count() + 3
    plain = enrich.enrich_trips(trips, readings, True)
    spread = enrich.enrich_trips(trips, readings, False, trips_per_salt=300)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    # the trips of that hour meet the reading in several tasks
    text = spread._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in text and "BroadcastNestedLoopJoin" not in text
    assert enrich.heavy_hours(trips, 10_000).isEmpty()


def test_only_the_days_of_feeds_in_the_source_are_emptied(spark, tmp_path):
    raw, target = str(tmp_path / "raw"), str(tmp_path / "trips")
    inputs.write_ride_months(spark, SF_DIR, raw)
    jobs.build_trips(spark, raw, target)

    def counts():
        found = tables.scan_layer(spark, target, schemas.TRIPS).groupBy("taxi_type").count().collect()
        return {r.taxi_type: r["count"] for r in found}

    before = counts()
    one = str(tmp_path / "one")
    for month in Path(raw, "taxi_type=yellow").glob("year=*/month=*"):
        spark.read.parquet(str(month)).write.parquet(f"{one}/{month.relative_to(raw)}")
    window = {"replace": "partitions", "first_day": "2024-01-02", "last_day": "2024-01-04"}
    jobs.build_trips(spark, one, target, **window)
    assert counts() == before
    with pytest.raises(FileNotFoundError):
        jobs.build_trips(spark, one, target, ["green"], **window)
    assert counts() == before
