from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyfare.functions.arrays import first_filled, item_or_null
from skyfare.operators.readings import dedupe_hours, flatten_readings, normalize_readings
from skyfare.schemas import READING_DOCUMENT, READINGS
from skyfare.sources.tables import scan_reading_documents


def document(root, day, hourly, **extra):
    folder = root / f"date={day}"
    folder.mkdir(parents=True)
    text = json.dumps({"hourly": hourly, **extra}, indent=2)
    (folder / "weather.json").write_text(text)


def read(spark, root):
    rows = normalize_readings(flatten_readings(scan_reading_documents(spark, str(root))))
    return {r.timestamp: tuple(r)[1:4] for r in rows.collect()}


def test_documents_on_disk(spark, tmp_path):
    document(
        tmp_path,
        "2024-01-01",
        {
            "time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"],
            "temperature_2m": [1, 2.5],  # short, and mixes integers with fractions
            "precipitation": [0.0, None, 0.1, 9.9],  # long
            "wind_speed_10m": ["3.5", "x", 4],  # text
        },
        _metadata={"endpoint": "somewhere", "fetched_for_date": "2024-01-01"},
        latitude=40.7,
    )
    document(
        tmp_path,
        "2024-01-02",
        {
            "time": ["2024-01-02T00:00:00", "n/a", None],
            "wind_speed_10m": [],
            "windspeed_10m": [7.0, 8.0],
        },
    )
    document(tmp_path, "2024-01-03", {})
    (tmp_path / "_state.json").write_text('{"last_ingested_date": "2024-01-03"}')
    assert read(spark, tmp_path) == {
        datetime(2024, 1, 1, 0): (1.0, 0.0, 3.5),
        datetime(2024, 1, 1, 1): (2.5, None, None),
        datetime(2024, 1, 1, 2): (None, 0.1, 4.0),
        datetime(2024, 1, 2, 0): (None, None, 7.0),
    }


def test_broken_document_stops_the_job(spark, tmp_path):
    folder = tmp_path / "date=2024-01-01"
    folder.mkdir()
    (folder / "weather.json").write_text('{"hourly": {"time": [')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read(spark, tmp_path)


def test_no_documents(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_reading_documents(spark, str(tmp_path / "absent"))


def test_normalized_schema(spark):
    documents = spark.createDataFrame([], READING_DOCUMENT)
    schema = normalize_readings(flatten_readings(documents)).schema
    assert {(f.name, f.dataType) for f in schema} == {(f.name, f.dataType) for f in READINGS}


def test_array_expressions(spark):
    df = spark.createDataFrame(
        [([1, 2], [9]), ([], [9]), (None, [9]), (None, None)], "a array<int>, b array<int>"
    )
    got = df.select(
        item_or_null(F.col("a"), F.lit(1)).alias("second"), first_filled(F.col("a"), F.col("b")).alias("f")
    )
    assert [tuple(r) for r in got.collect()] == [(2, [1, 2]), (None, [9]), (None, [9]), (None, None)]


numbers = st.none() | st.lists(st.none() | st.sampled_from(["1.5", "2", "bad"]), max_size=5)
times = st.none() | st.lists(
    st.sampled_from(["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01 02:00:00", "later", None]), max_size=5
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(times, numbers, numbers, numbers, numbers), max_size=4))
def test_flatten_equals_brute_force(spark, docs):
    def at(values, i):
        return values[i] if values is not None and i < len(values) else None

    expected = []
    for time, temperature, rain, wind, old_wind in docs:
        wind = wind or old_wind
        for i, t in enumerate(time or []):
            expected.append((t, at(temperature, i), at(rain, i), at(wind, i)))
    df = spark.createDataFrame([(d, date(2024, 1, 1)) for d in docs], READING_DOCUMENT)
    got = [tuple(r) for r in flatten_readings(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_dedupe_hours(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1, 5.0), ("2024-01-01", 1, 4.0), ("2024-01-01", 2, 6.0)], "date string, hour int, t double"
    )
    assert sorted(tuple(r) for r in dedupe_hours(df).collect()) == [
        ("2024-01-01", 1, 4.0),
        ("2024-01-01", 2, 6.0),
    ]
