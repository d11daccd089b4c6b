"""Names, types and keys of every table the library reads or writes.

All times are wall-clock ``timestamp_ntz`` values: both feeds publish local
time without a zone, and a zoned type would move readings inside the hour that
daylight saving skips.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class TripField(NamedTuple):
    """One conformed trip column and the raw names it may arrive under."""

    name: str
    type: T.DataType
    raw_names: tuple[str, ...]


# Raw column names in order of preference, any letter case.
TRIP_FIELDS = (
    TripField("vendor_id", T.IntegerType(), ("vendorid", "vendor_id")),
    TripField(
        "pickup_datetime",
        T.TimestampNTZType(),
        ("tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime"),
    ),
    TripField(
        "dropoff_datetime",
        T.TimestampNTZType(),
        ("tpep_dropoff_datetime", "lpep_dropoff_datetime", "dropoff_datetime"),
    ),
    TripField("pu_location_id", T.IntegerType(), ("pulocationid", "pu_location_id")),
    TripField("do_location_id", T.IntegerType(), ("dolocationid", "do_location_id")),
    TripField("passenger_count", T.DoubleType(), ("passenger_count",)),
    TripField("trip_distance", T.DoubleType(), ("trip_distance",)),
    TripField("fare_amount", T.DoubleType(), ("fare_amount",)),
    TripField("total_amount", T.DoubleType(), ("total_amount",)),
    TripField("payment_type", T.IntegerType(), ("payment_type",)),
)

# The columns that identify one trip.
TRIP_KEY = (
    "vendor_id",
    "pickup_datetime",
    "dropoff_datetime",
    "pu_location_id",
    "do_location_id",
    "total_amount",
)

# A feed without one of these cannot survive cleaning: its filter is never true.
REQUIRED_TRIP_FIELDS = ("pickup_datetime", "dropoff_datetime", "trip_distance", "fare_amount")

READING_MEASURES = ("temperature_2m", "precipitation", "windspeed_10m")

TRIPS_PARTITIONS = ("pickup_date", "taxi_type")
READINGS_PARTITIONS = ("date",)
ENRICHED_PARTITIONS = ("pickup_date",)
DAILY_PARTITIONS = ("date",)

_PAYLOAD = [T.StructField(f.name, f.type) for f in TRIP_FIELDS]
_MEASURES = [T.StructField(name, T.DoubleType()) for name in READING_MEASURES]

# Partition columns come last, as a Parquet scan returns them.
TRIPS = T.StructType(
    [
        *_PAYLOAD,
        T.StructField("pickup_hour", T.IntegerType()),
        T.StructField("pickup_date", T.DateType()),
        T.StructField("taxi_type", T.StringType()),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        *_MEASURES,
        T.StructField("hour", T.IntegerType()),
        T.StructField("date", T.DateType()),
    ]
)

ENRICHED = T.StructType(
    [
        *_PAYLOAD,
        T.StructField("pickup_hour", T.IntegerType()),
        T.StructField("taxi_type", T.StringType()),
        *_MEASURES,
        T.StructField("pickup_date", T.DateType()),
    ]
)

DAILY = T.StructType(
    [
        T.StructField("total_trips", T.LongType()),
        T.StructField("avg_fare_amount", T.DoubleType()),
        T.StructField("avg_total_amount", T.DoubleType()),
        T.StructField("avg_trip_distance", T.DoubleType()),
        T.StructField("surge_proxy", T.DoubleType()),
        T.StructField("avg_temp", T.DoubleType()),
        T.StructField("total_precip", T.DoubleType()),
        T.StructField("payment_type_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("date", T.DateType()),
    ]
)

# One JSON document per day. Measures are read as text and cast later, so a
# number written as a string stays readable. A payload field called _metadata
# is left out on purpose: Spark's own file-metadata column has that name.
_TEXTS = T.ArrayType(T.StringType())
READING_DOCUMENT = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", _TEXTS),
                    T.StructField("temperature_2m", _TEXTS),
                    T.StructField("precipitation", _TEXTS),
                    T.StructField("wind_speed_10m", _TEXTS),
                    T.StructField("windspeed_10m", _TEXTS),
                ]
            ),
        ),
        T.StructField("date", T.DateType()),
    ]
)

# A document after landing, tagged with the day and the place it came from.
LANDED_DOCUMENT = T.StructType(
    [
        READING_DOCUMENT["hourly"],
        T.StructField(
            "provenance",
            T.StructType(
                [
                    T.StructField("fetched_for_date", T.DateType()),
                    T.StructField("endpoint", T.StringType()),
                ]
            ),
        ),
        READING_DOCUMENT["date"],
    ]
)
