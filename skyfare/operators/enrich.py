"""Left join of trips to the weather of their pickup hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.operators.readings import dedupe_hours
from skyfare.schemas import READING_MEASURES

# One hour is two keys and three doubles, under 100 bytes in a broadcast hash
# table, so this many hours (114 years of one station) stay under 100 MB.
MAX_BROADCAST_HOURS = 1_000_000

# Trips of one hour that one task joins; an hour with more is spread over several.
TRIPS_PER_SALT = 2_000_000

# Hours that can be spread, which bounds the list of them: no other hour holds
# more than a ten-thousandth of all trips.
MOST_HEAVY_HOURS = 10_000

# Trips without a date or hour match nothing; they are dealt out over so many keys.
NO_HOUR_SALTS = 1024


def broadcast_fits(readings: DataFrame, max_hours: int = MAX_BROADCAST_HOURS) -> bool:
    """Whether the distinct hours of ``readings`` are few enough to broadcast; runs a count."""
    return readings.select("date", "hour").distinct().count() <= max_hours


def heavy_hours(trips: DataFrame, trips_per_salt: int = TRIPS_PER_SALT) -> DataFrame:
    """``heavy_date, heavy_hour, salts`` of the hours with more trips than one task should join; runs a count."""
    hours = trips.where("pickup_date is not null and pickup_hour is not null").groupBy("pickup_date", "pickup_hour")
    busiest = hours.count().orderBy(F.desc("count"), "pickup_date", "pickup_hour").limit(MOST_HEAVY_HOURS)
    found = [
        (r.pickup_date, r.pickup_hour, -(-r["count"] // trips_per_salt))
        for r in busiest.where(F.col("count") > trips_per_salt).collect()
    ]
    return trips.sparkSession.createDataFrame(found, "heavy_date date, heavy_hour int, salts int")


def _salted_join(trips: DataFrame, hourly: DataFrame, same_hour: Column, trips_per_salt: int) -> DataFrame:
    """Left join of trips to readings by hour, the heavy hours spread by as many salts as their own counts ask for.

    Readings of heavy hours are copied once for each salt of theirs, the others not at all.
    """
    heavy = F.broadcast(heavy_hours(trips, trips_per_salt))
    # The salt is a hash of the trip, so a task that runs again after an
    # executor loss gives each row the same salt.
    plain = [f.name for f in trips.schema if isinstance(f.dataType, T.AtomicType)]
    mixed = F.xxhash64(*plain)
    nowhere = F.col("pickup_date").isNull() | F.col("pickup_hour").isNull()
    salt = F.when(nowhere, F.pmod(mixed, F.lit(NO_HOUR_SALTS))).otherwise(
        F.pmod(mixed, F.coalesce("salts", F.lit(1)))
    )
    of_trip = (F.col("pickup_date") == F.col("heavy_date")) & (F.col("pickup_hour") == F.col("heavy_hour"))
    salted = trips.join(heavy, of_trip, "left").withColumn("_salt", salt.cast("int"))
    same = same_hour & (F.col("_salt") == F.col("_copy"))
    joined = salted.drop(*heavy.columns).join(copied_readings(hourly, heavy), same, "left")
    return joined.drop("_salt", "_copy")


def copied_readings(hourly: DataFrame, heavy: DataFrame) -> DataFrame:
    """The readings of each hour once, those of a heavy hour once for each of its salts, numbered by ``_copy``."""
    of_reading = (F.col("_date") == F.col("heavy_date")) & (F.col("_hour") == F.col("heavy_hour"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    return hourly.join(heavy, of_reading, "left").withColumn("_copy", copies).drop(*heavy.columns)


def enrich_trips(
    trips: DataFrame,
    readings: DataFrame,
    broadcast_readings: bool | None = None,
    trips_per_salt: int = TRIPS_PER_SALT,
) -> DataFrame:
    """Every trip once, with the reading of its date and hour or NULLs.

    Readings are reduced to one per hour first, so a repeated hour cannot
    multiply trips. With ``broadcast_readings`` the trips are not shuffled at
    all; without it the join shuffles, and hours with more than
    ``trips_per_salt`` trips are spread over several tasks by their counts. None
    counts the hours of the readings and decides.
    """
    if broadcast_readings is None:
        broadcast_readings = broadcast_fits(readings)
    trips = trips.withColumns(
        {"pickup_date": F.to_date("pickup_date"), "pickup_hour": F.col("pickup_hour").cast("int")}
    )
    hourly = dedupe_hours(
        readings.select(
            F.to_date("date").alias("date"),
            F.col("hour").cast("int").alias("hour"),
            *READING_MEASURES,
        ).filter("date is not null and hour is not null")
    ).withColumnsRenamed({"date": "_date", "hour": "_hour"})
    same_hour = (F.col("pickup_date") == F.col("_date")) & (F.col("pickup_hour") == F.col("_hour"))
    if broadcast_readings:
        joined = trips.join(F.broadcast(hourly), same_hour, "left")
    else:
        joined = _salted_join(trips, hourly, same_hour, trips_per_salt)
    return joined.drop("_date", "_hour")
