from __future__ import annotations

import json
import re
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyfare.operators import conform
from skyfare.operators.inspect import sample_rows, table_profile
from skyfare.schemas import LANDED_DOCUMENT
from skyfare.sources import files, landing, plans, settings, tables
from skyfare.sources.scratch import scratch_path
from skyfare.sources.settings import sized_shuffles
from skyfare.streaming.readings import land_available


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- plans


def test_plan_months(spark):
    assert rows(plans.plan_months(plans.bounds(spark, "2023-11", "2024-02"))) == [
        (2023, 11),
        (2023, 12),
        (2024, 1),
        (2024, 2),
    ]
    assert rows(plans.plan_months(plans.bounds(spark, "2024-01", "2024-01"))) == [(2024, 1)]
    with pytest.raises(PySparkException, match="after end month 2023-12"):
        plans.plan_months(plans.bounds(spark, "2024-01", "2023-12")).collect()


def test_plan_days(spark):
    window = plans.bounds(spark, "2024-02-28", "2024-03-01")
    assert [r[0].isoformat() for r in rows(plans.plan_days(window))] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert rows(plans.plan_days(plans.bounds(spark, "2024-03-01", "2024-02-28"))) == []


def days(df):
    return [d.day for (d,) in rows(df)]


def test_plan_incremental_follows_the_last_landed_day(spark):
    window = plans.bounds(spark, "2024-01-01", "2024-01-05")
    landed = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),)], "date date")
    assert days(plans.plan_incremental(window, None, "2024-01-10")) == [1, 2, 3, 4, 5]
    assert days(plans.plan_incremental(window, landed.limit(0), "2024-01-10")) == [1, 2, 3, 4, 5]
    assert days(plans.plan_incremental(window, landed, "2024-01-10")) == [4, 5]
    assert days(plans.plan_incremental(window, landed, "2024-01-04")) == [4]
    assert days(plans.plan_incremental(window, landed, "2024-01-02")) == []
    assert days(plans.plan_gaps(window, landed, "2024-01-10")) == [2, 4, 5]
    early = spark.createDataFrame([(date(2023, 6, 1),)], "date date")
    assert days(plans.plan_incremental(window, early, "2024-01-10")) == [1, 2, 3, 4, 5]


def test_plan_manifest(spark):
    months = plans.plan_months(plans.bounds(spark, "2024-01", "2024-01"))
    row = plans.plan_manifest(months, "yellow", f"landing/{plans.FILE_NAME}", "bronze").first()
    assert row.source == "landing/yellow_tripdata_2024-01.parquet"
    assert row.destination == "bronze/taxi_type=yellow/year=2024/month=01/yellow_tripdata_2024-01.parquet"


# --- trip tables


def write_month(spark, root, month, schema, *data, taxi_type="yellow"):
    path = f"{root}/taxi_type={taxi_type}/year=2024/month={month:02d}"
    spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(path)


def test_scan_bridges_schema_drift(spark, tmp_path):
    root = str(tmp_path)
    write_month(spark, root, 1, "VendorID bigint, fare_amount double", (1, 1.5))
    write_month(spark, root, 2, "VendorID int, fare_amount bigint", (2, 2))
    write_month(spark, root, 3, "vendor_id double, Fare_Amount float", (3.0, 3.0))
    write_month(spark, root, 4, "VendorID bigint, fare_amount double", (4, 4.5))
    write_month(spark, root, 1, "VendorID bigint, fare_amount double", (9, 9.5), taxi_type="green")
    frames = tables.scan_raw_trips(spark, root, ["yellow"])
    assert len(frames) == 3
    trips = conform.union_feeds([conform.conform_trips(f, F.col("taxi_type")) for f in frames])
    assert rows(trips.select("vendor_id", "fare_amount", "taxi_type")) == [
        (1, 1.5, "yellow"),
        (2, 2.0, "yellow"),
        (3, 3.0, "yellow"),
        (4, 4.5, "yellow"),
    ]
    window = tables.scan_raw_trips(spark, root, None, "2024-02", "2024-03")
    assert sorted(r.month for f in window for r in f.collect()) == ["02", "03"]
    assert rows(files.partition_values(spark, root, "taxi_type")) == [("green",), ("yellow",)]
    with pytest.raises(FileNotFoundError):
        tables.scan_raw_trips(spark, root, ["purple"])


def test_special_characters_in_partition_values(spark, tmp_path):
    root = str(tmp_path / "a b")
    df = spark.createDataFrame([(1, "x:y+z", "2024", "01")], "id int, taxi_type string, year string, month string")
    df.write.partitionBy("taxi_type", "year", "month").parquet(root)
    assert rows(files.partition_values(spark, root, "taxi_type")) == [("x:y+z",)]
    assert files.partition_inventory(spark, root).first().partition == "taxi_type=x%3Ay+z"
    (frame,) = tables.scan_raw_trips(spark, root, ["x:y+z"])
    assert rows(frame) == [(1, "x:y+z", "2024", "01")]


def test_absent_trip_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.scan_raw_trips(spark, str(tmp_path / "absent"))
    assert files.partition_values(spark, str(tmp_path / "absent"), "taxi_type").isEmpty()
    assert files.partition_inventory(spark, str(tmp_path / "absent")).isEmpty()
    assert tables.scan_if_exists(spark, str(tmp_path / "absent")) is None


def test_land_missing_months(spark, tmp_path):
    source, target = str(tmp_path / "landing"), str(tmp_path / "bronze")
    schema = "VendorID bigint, fare_amount double"
    write_month(spark, source, 1, schema, (1, 1.0))
    write_month(spark, source, 2, "VendorID int, fare_amount bigint", (2, 2))

    def land(start, end):
        return landing.land_missing_months(spark, source, target, "yellow", start, end)

    assert land("2024-01", "2024-01") == [(2024, 1)]
    assert land("2024-01", "2024-02") == [(2024, 2)]
    assert land("2024-01", "2024-02") == []
    with pytest.raises(RuntimeError, match="yellow 2024-03, yellow 2024-04"):
        land("2024-01", "2024-04")
    write_month(spark, source, 3, schema)  # a file without rows
    with pytest.raises(RuntimeError, match="yellow 2024-03"):
        land("2024-01", "2024-03")
    frames = tables.scan_raw_trips(spark, target)
    assert sorted(r.VendorID for f in frames for r in f.collect()) == [1, 2]


# --- sinks


def test_replacing_the_table_or_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id int, pickup_date date, taxi_type string"
    first = spark.createDataFrame([(1, date(2024, 1, 1), "y"), (2, date(2024, 1, 2), "y")], schema)
    second = spark.createDataFrame([(3, date(2024, 1, 2), "y"), (4, date(2024, 1, 2), "g")], schema)
    keys = ("pickup_date", "taxi_type")
    tables.write_layer(first, path, keys)
    tables.write_layer(second, path, keys, replace="partitions")
    assert rows(tables.scan_layer(spark, path, first.schema).select("id")) == [(1,), (3,), (4,)]
    tables.write_layer(second, path, keys)
    assert rows(tables.scan_layer(spark, path, first.schema).select("id")) == [(3,), (4,)]


def test_inventory_and_files_per_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 3000, 1, 8).selectExpr("id", "date_add(date'2024-01-01', cast(id % 30 as int)) as date")
    tables.write_layer(df, path, ["date"])
    inventory = files.partition_inventory(spark, path).collect()
    assert [r.partition for r in inventory] == [f"date=2024-01-{d:02d}" for d in range(1, 21)]
    assert {r.files for r in inventory} == {1}


def test_a_hot_day_is_split_over_tasks(spark, tmp_path):
    """One day holds a third of the rows: its write is shared, the small days stay whole."""
    path = str(tmp_path / "t")
    df = spark.range(0, 300_000, 1, 16).selectExpr(
        "id", "uuid() as payload", "date_add(date'2024-01-01', cast(if(id % 3 = 0, 0, id % 10) as int)) as date"
    )
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "512k",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        tables.write_layer(df, path, ["date"])
    finally:
        for name in small:
            spark.conf.unset(name)
    files_of = {r.partition: r.files for r in files.partition_inventory(spark, path).collect()}
    assert files_of["date=2024-01-01"] > 3
    assert sum(files_of.values()) < 40
    assert spark.read.parquet(path).count() == 300_000


def test_profile_and_sample(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id int, name string")
    assert rows(table_profile(df)) == [(1, "id", "int", 3), (2, "name", "string", 3)]
    assert rows(sample_rows(df, ["id"], 2)) == [(1, "a"), (2, "b")]


# --- landing of days


def put(root, day, *hours):
    folder = root / f"date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    hourly = {"time": [f"{day}T{h:02d}:00" for h in hours], "temperature_2m": [1.0] * len(hours)}
    (folder / f"weather-{hours[0]}.json").write_text(json.dumps({"hourly": hourly}, indent=2))


def landed(spark, path):
    return [r.date.day for r in tables.scan_layer(spark, path, LANDED_DOCUMENT).orderBy("date").collect()]


def test_land_new_days(spark, tmp_path):
    source, target = tmp_path / "landing", str(tmp_path / "bronze")

    def land(end, today="2024-02-01", **more):
        return landing.land_new_days(spark, str(source), target, "2024-01-01", end, today, **more)

    put(source, "2024-01-01", 0)
    put(source, "2024-01-02", 0)
    put(source, "2024-01-04", 0)
    assert land("2024-01-03", today="2024-01-02") == ["2024-01-01", "2024-01-02"]
    assert land("2024-01-02") == []
    with pytest.raises(FileNotFoundError, match="2024-01-03"):
        land("2024-01-04")
    assert landed(spark, target) == [1, 2]
    assert landing.land_new_days(spark, str(source), target, "2024-01-04", "2024-01-04", "2024-02-01") == ["2024-01-04"]
    put(source, "2024-01-03", 0)
    assert land("2024-01-04") == []  # below the mark
    assert land("2024-01-04", fill_gaps=True) == ["2024-01-03"]
    assert landed(spark, target) == [1, 2, 3, 4]
    provenance = tables.scan_layer(spark, target, LANDED_DOCUMENT).orderBy("date").first().provenance
    assert provenance.fetched_for_date == date(2024, 1, 1)
    assert provenance.endpoint.endswith("date=2024-01-01/weather-0.json")


def test_stream_lands_each_document_once(spark, tmp_path):
    source, target, state = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "state")
    put(source, "2024-01-01", 0)
    put(source, "2024-01-02", 0)
    land = lambda: land_available(spark, str(source), target, state)
    assert land() == (2, [])
    assert landed(spark, target) == [1, 2]
    assert land() == (0, [])
    assert landed(spark, target) == [1, 2]
    put(source, "2024-01-03", 0)
    put(source, "2024-01-01", 5)  # late, for an old day
    assert land() == (2, [])
    assert landed(spark, target) == [1, 1, 2, 3]


def test_stream_lands_good_documents_beside_broken_ones(spark, tmp_path):
    source, target, state = tmp_path / "landing", str(tmp_path / "bronze"), str(tmp_path / "state")
    put(source, "2024-01-01", 0)
    put(source, "2024-01-03", 0)
    (source / "date=2024-01-02").mkdir()
    (source / "date=2024-01-02" / "weather-0.json").write_text('{"hourly": {"time": ["2024-01-02T')
    found = land_available(spark, str(source), target, state)
    assert found.documents == 2
    assert [name[-30:] for name in found.broken] == ["date=2024-01-02/weather-0.json"]
    assert landed(spark, target) == [1, 3]
    assert land_available(spark, str(source), target, state) == (0, [])
    put(source, "2024-01-02", 1)  # mended
    assert land_available(spark, str(source), target, state) == (1, [])
    assert landed(spark, target) == [1, 2, 3]


def test_given_endpoint(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),)], "date date")
    row = landing.tag_provenance(df, "archive").first()
    assert tuple(row.provenance) == (date(2024, 1, 1), "archive")


def test_scratch_is_under_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(f"{shared}/x-")


def test_shuffles_grow_with_the_input(spark):
    df = spark.range(100).selectExpr("id % 7 as k").groupBy("k").count()

    def partitions():
        text = df.select("k")._jdf.queryExecution().executedPlan().toString()
        return int(re.search(r"hashpartitioning\(k#\d+L, (\d+)\)", text).group(1))

    with sized_shuffles(spark, 10**6):
        assert partitions() == 8
        assert spark.conf.get(settings.TARGET, None) is None
    with sized_shuffles(spark, 10**12):
        assert partitions() == 3726
        assert spark.conf.get(settings.TARGET) == f"{512 * 2**20}b"
    with sized_shuffles(spark, 100 * 10**12):
        assert partitions() == 372_530
    assert spark.conf.get(settings.PARTITIONS, None) is None
    assert spark.conf.get(settings.TARGET, None) is None


def test_listing_does_not_open_files(spark, tmp_path):
    folder = tmp_path / "a=01" / "b=x"
    folder.mkdir(parents=True)
    (folder / "one").write_text("12345")
    (folder / "two").write_text("not a table at all")
    (row,) = files.list_partitions(spark, str(tmp_path)).collect()
    assert tuple(row)[1:] == (2, 23, "01", "x")
    assert files.table_bytes(spark, str(tmp_path)) == 23
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "1t"


def test_a_month_of_differing_files_keeps_all_values(spark, tmp_path):
    root = str(tmp_path / "raw")
    month = f"{root}/taxi_type=yellow/year=2024/month=01"
    spark.range(2).selectExpr("id as VendorID", "1.5D as fare_amount", "2L as passenger_count").write.parquet(month)
    spark.range(2, 3).selectExpr("id as VendorID").write.mode("append").parquet(month)
    other = f"{root}/taxi_type=yellow/year=2024/month=02"
    spark.range(1).selectExpr("id as VendorID", "1L as passenger_count").write.parquet(other)
    spark.range(1).selectExpr("id as VendorID", "'2' as passenger_count").write.mode("append").parquet(other)
    frames = tables.scan_raw_trips(spark, root)
    rows = [tuple(r) for f in frames for r in f.selectExpr("month", "VendorID", "string(passenger_count)").collect()]
    assert sorted(rows, key=str) == [
        ("01", 0, "2"),
        ("01", 1, "2"),
        ("01", 2, None),
        ("02", 0, "1"),
        ("02", 0, "2"),
    ]


def test_stray_directories_do_not_stop_a_landing(spark, tmp_path):
    stray = tmp_path / "date=__HIVE_DEFAULT_PARTITION__"
    stray.mkdir()
    (stray / "weather.json").write_text("{}")
    good = tmp_path / "date=2024-01-02"
    good.mkdir()
    (good / "weather.json").write_text("{}")
    assert [str(r.date) for r in landing.landed_days(spark, str(tmp_path)).collect()] == ["2024-01-02"]
