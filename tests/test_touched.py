"""Change propagation by touched days, and replacements that died half-way."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from skyfare import schemas
from skyfare.plans import jobs
from skyfare.registry import inputs
from skyfare.sources import journal, tables
from skyfare.streaming import touched

SF_DIR = "/root/testdata/sf0.001"


def rows(spark, path, schema):
    return sorted(map(str, tables.scan_layer(spark, path, schema).collect()))


def layers(spark, layout):
    return [
        rows(spark, layout.trips, schemas.TRIPS),
        rows(spark, layout.readings, schemas.READINGS),
        rows(spark, layout.enriched, schemas.ENRICHED),
        rows(spark, layout.daily, schemas.DAILY),
    ]


def build_all(spark, layout):
    jobs.build_trips(spark, layout.raw_trips, layout.trips)
    jobs.build_readings(spark, tables.scan_reading_documents(spark, layout.raw_readings), layout.readings)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched)
    jobs.build_daily(spark, layout.enriched, layout.daily)


def written(spark, path):
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return {(r.path, r.modificationTime) for r in files.collect()}


def test_touched_days_equal_a_full_build(spark, tmp_path):
    layout, checkpoint = jobs.Layout(str(tmp_path / "city")), str(tmp_path / "checkpoint")
    documents = inputs.reading_documents(spark, SF_DIR)
    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips, without="2024-01-09")
    inputs.write_documents(documents.filter("date < DATE '2024-01-15'"), layout.raw_readings)
    first = touched.rebuild_touched(spark, layout, checkpoint, "json")
    assert "2024-01-08" in first and "2024-01-09" in first  # the document of the day without trips
    before = written(spark, layout.enriched)

    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips, only="2024-01-09")
    inputs.write_documents(documents.filter("date = DATE '2024-01-20'"), layout.raw_readings)
    # several small batches reach the same tables
    assert touched.rebuild_touched(spark, layout, checkpoint, "json", files_per_batch=1) == ["2024-01-09", "2024-01-20"]
    after = written(spark, layout.enriched)
    moved = {path for path, _ in before ^ after}
    assert moved and all("pickup_date=2024-01-09" in path or "pickup_date=2024-01-20" in path for path in moved)

    whole = jobs.Layout(str(tmp_path / "whole"))
    whole.raw_trips, whole.raw_readings = layout.raw_trips, layout.raw_readings
    build_all(spark, whole)
    expected = layers(spark, whole)
    assert layers(spark, layout) == expected

    # nothing new: nothing is built; a batch that is done again changes nothing
    assert touched.rebuild_touched(spark, layout, checkpoint, "json") == []
    assert written(spark, layout.enriched) == after
    assert touched.rebuild_days(spark, layout, ["2024-01-09"], ["2024-01-20"], "json") == ["2024-01-09", "2024-01-20"]
    assert layers(spark, layout) == expected


def test_trips_before_any_reading(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path / "city"))
    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips)
    assert touched.rebuild_days(spark, layout, ["2024-01-09"], []) == ["2024-01-09"]
    enriched = tables.scan_layer(spark, layout.enriched, schemas.ENRICHED)
    assert enriched.count() > 0 and enriched.filter("temperature_2m IS NOT NULL").isEmpty()


def test_raw_folders_are_required(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        touched.rebuild_touched(spark, jobs.Layout(str(tmp_path / "none")), str(tmp_path / "checkpoint"))


def test_days_narrow_a_window(spark, tmp_path):
    layout = jobs.Layout(str(tmp_path))
    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips)
    days = ["2024-01-12", "2024-01-08"]
    jobs.build_trips(spark, layout.raw_trips, layout.trips, replace="partitions", days=days)
    found = tables.scan_layer(spark, layout.trips, schemas.TRIPS).select(F.col("pickup_date").cast("string"))
    assert sorted(r.pickup_date for r in found.distinct().collect()) == sorted(days)
    # no day at all replaces nothing
    jobs.build_trips(spark, layout.raw_trips, layout.trips, replace="partitions", days=[])
    assert sorted(r.pickup_date for r in found.distinct().collect()) == sorted(days)


@pytest.fixture(scope="module")
def built_once(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("once")
    layout = jobs.Layout(str(root / "city"))
    inputs.write_ride_months(spark, SF_DIR, layout.raw_trips)
    inputs.write_documents(inputs.reading_documents(spark, SF_DIR), layout.raw_readings)
    build_all(spark, layout)
    inputs.write_ride_months(spark, SF_DIR, str(root / "changed"), without="2024-01-09")
    return root


@pytest.fixture
def built(built_once, tmp_path):
    """All tables of all rides, over raw trips that have lost a day since."""
    shutil.copytree(built_once / "city", tmp_path / "city")
    layout = jobs.Layout(str(tmp_path / "city"))
    layout.raw_trips = str(built_once / "changed")
    return layout


def run(spark, layout, feed, first, last):
    jobs.run_pipeline(
        spark,
        layout,
        landing_trips="",
        landing_readings="",
        taxi_type=feed,
        start_month="2024-01",
        end_month="2024-01",
        start_date="2024-01-01",
        end_date="2024-01-31",
        today="2024-02-20",
        skip_steps=["bronze_tlc", "bronze_weather", "quality"],
        raw_readings_format="json",
        replace="partitions",
        first_day=first,
        last_day=last,
    )


class Died(Exception):
    pass


@pytest.mark.parametrize("deaths", [1, 3])
def test_a_run_that_died_between_write_and_removal_is_ended_by_the_next(spark, built, monkeypatch, deaths):
    """One death is that of the trips' removal, three that of the daily table's; the next run has another window."""
    calls = []
    removal = jobs.drop_emptied_partitions

    def dies(*args):
        calls.append(args)
        if len(calls) == deaths:
            raise Died
        return removal(*args)

    monkeypatch.setattr(jobs, "drop_emptied_partitions", dies)
    with pytest.raises(Died):
        run(spark, built, "yellow", "2024-01-08", "2024-01-10")
    monkeypatch.setattr(jobs, "drop_emptied_partitions", removal)
    assert journal.pending(spark, built.root)
    run(spark, built, "green", "2024-01-20", "2024-01-20")
    trips = tables.scan_layer(spark, built.trips, schemas.TRIPS)
    left = trips.filter("pickup_date = DATE '2024-01-09'").select("taxi_type").distinct().collect()
    assert sorted(r.taxi_type for r in left) == ["green", "hired"]
    daily = tables.scan_layer(spark, built.daily, schemas.DAILY)
    counted = trips.groupBy(F.col("pickup_date").alias("date")).count()
    assert daily.select("date", F.col("total_trips").alias("count")).exceptAll(counted).isEmpty()
    assert counted.exceptAll(daily.select("date", F.col("total_trips").alias("count"))).isEmpty()
    for root in (built.root, built.trips, built.readings, built.enriched, built.daily):
        assert journal.pending(spark, root) == []


def test_the_same_window_is_not_done_twice(spark, built, monkeypatch):
    window = {"replace": "partitions", "first_day": "2024-01-08", "last_day": "2024-01-10"}
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "write_layer", lambda *a, **k: (_ for _ in ()).throw(Died()))
        for _ in range(2):
            with pytest.raises(Died):
                jobs.build_daily(spark, built.enriched, built.daily, **window)
    assert len(journal.pending(spark, built.daily)) == 1
    writes = []
    write = jobs.write_layer
    monkeypatch.setattr(jobs, "write_layer", lambda *a, **k: writes.append(a) or write(*a, **k))
    jobs.build_daily(spark, built.enriched, built.daily, **window)
    assert len(writes) == 1 and journal.pending(spark, built.daily) == []


def test_refused_input_does_not_stand_in_the_way(spark, built):
    with pytest.raises(FileNotFoundError):
        run(spark, built, "black", "2024-01-08", "2024-01-10")
    assert journal.pending(spark, built.root) == []
    run(spark, built, "green", "2024-01-20", "2024-01-20")


def test_a_whole_table_needs_no_note(spark, built):
    journal.begin(spark, built.daily, {"paths": {"enriched": "gone"}, "window": [None, None, None]})
    jobs.build_daily(spark, built.enriched, built.daily)
    assert journal.pending(spark, built.daily) == []
