"""From nested daily documents to one typed row per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.functions.arrays import first_filled, item_or_null
from skyfare.functions.parsing import READING_TIME_FORMATS, tolerant_cast, wall_clock
from skyfare.operators.dedupe import keep_one
from skyfare.schemas import READING_MEASURES


def flatten_readings(documents: DataFrame) -> DataFrame:
    """One row per entry of ``hourly.time``, still untyped.

    The length of ``time`` rules: shorter value arrays are padded with NULL and
    longer ones are cut. Each document turns into an array of small structs
    before the explode, so no row carries the whole arrays along.
    """
    hourly = F.col("hourly")
    wind = first_filled(hourly["wind_speed_10m"], hourly["windspeed_10m"])
    zipped = F.transform(
        hourly["time"],
        lambda time, i: F.struct(
            time.alias("timestamp"),
            item_or_null(hourly["temperature_2m"], i).alias("temperature_2m"),
            item_or_null(hourly["precipitation"], i).alias("precipitation"),
            item_or_null(wind, i).alias("windspeed_10m"),
        ),
    )
    return documents.select(F.inline(zipped))


def normalize_readings(rows: DataFrame) -> DataFrame:
    """Typed readings with date and hour; rows with an unreadable time drop."""
    types = {f.name: f.dataType for f in rows.schema}
    time = wall_clock(F.col("timestamp"), types["timestamp"], READING_TIME_FORMATS)
    typed = rows.select(
        time.alias("timestamp"),
        *[tolerant_cast(F.col(m), types[m], T.DoubleType()).alias(m) for m in READING_MEASURES],
    )
    return typed.filter(F.col("timestamp").isNotNull()).withColumns(
        {"date": F.to_date("timestamp"), "hour": F.hour("timestamp")}
    )


def dedupe_hours(readings: DataFrame) -> DataFrame:
    """One reading per date and hour."""
    return keep_one(readings, ["date", "hour"])
