"""Trip and weather inputs as projections of the driver's tables.

Every input is built from whole tables. Frames that stand for raw feeds use the
raw column names, so the operators have something to conform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.schemas import TRIP_FIELDS

# Which raw name each feed uses for each conformed column.
# The green feed has no passenger count.
FEED_NAMES = {
    "yellow": {
        "vendor_id": "VendorID",
        "pickup_datetime": "tpep_pickup_datetime",
        "dropoff_datetime": "tpep_dropoff_datetime",
        "pu_location_id": "PULocationID",
        "do_location_id": "DOLocationID",
        "passenger_count": "passenger_count",
    },
    "green": {
        "vendor_id": "VendorID",
        "pickup_datetime": "lpep_pickup_datetime",
        "dropoff_datetime": "lpep_dropoff_datetime",
        "pu_location_id": "PULocationID",
        "do_location_id": "DOLocationID",
    },
    "hired": {"passenger_count": "Passenger_Count"},
}

# Means of cents often lie exactly between two roundings, and engines add doubles
# up in different orders. This much takes a value off the tie before rounding.
OFF_TIE = 1.37e-7


def rounded(value: Column, digits: int = 4) -> Column:
    return F.round(value + F.lit(OFF_TIE), digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_feed(trips: DataFrame, taxi_type: str) -> DataFrame:
    """Trips of one type under the raw column names of its feed."""
    names = FEED_NAMES[taxi_type]
    renamed = trips.filter(F.col("taxi_type") == taxi_type).drop("taxi_type").withColumnsRenamed(names)
    return renamed if "passenger_count" in names else renamed.drop("passenger_count")


def shipped_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips: picked up when ordered, dropped off when shipped.

    About half end before they start and some fares are negative.
    """
    taxi_type = (
        F.when(F.col("l_returnflag") == "A", "yellow")
        .when(F.col("l_returnflag") == "R", "green")
        .otherwise("hired")
    )
    priority = F.col("o_orderpriority")
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("l_suppkey").alias("vendor_id"),
        F.col("o_orderdate").alias("pickup_datetime"),
        F.col("l_shipdate").alias("dropoff_datetime"),
        F.col("c_nationkey").alias("pu_location_id"),
        F.col("s_nationkey").alias("do_location_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("c_acctbal").alias("fare_amount"),
        F.col("l_extendedprice").alias("total_amount"),
        F.when(priority != "4-NOT SPECIFIED", F.left(priority, F.lit(1))).alias("payment_type"),
        taxi_type.alias("taxi_type"),
    )


def shipped_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    trips = shipped_trips(spark, sf_dir)
    return {name: as_feed(trips, name) for name in FEED_NAMES}


def delivered_twice(trips: DataFrame) -> DataFrame:
    """Every trip a second time, with one more passenger: the key repeats, the row does not."""
    return trips.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *[
            (F.col("passenger_count") + F.col("_copy")).alias(c) if c == "passenger_count" else F.col(c)
            for c in trips.columns
        ]
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw trips with minutes and hours; some end before they start."""
    kind = F.col("event_type")
    payment = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "purchase", 3).when(kind == "signup", 4)
    taxi_type = F.when(kind.isin("click", "view"), "yellow").when(kind == "purchase", "green").otherwise("hired")
    events = table(spark, sf_dir, "events").withColumn("k", _k())
    return events.select(
        F.col("user_id").alias("vendor_id"),
        F.col("ts").alias("pickup_datetime"),
        F.expr("ts + make_dt_interval(0, 0, k - 10)").alias("dropoff_datetime"),
        F.col("k").alias("pu_location_id"),
        (F.lit(99) - F.col("k")).alias("do_location_id"),
        F.when(kind != "purchase", F.col("k")).alias("passenger_count"),
        (F.col("k") / F.lit(4.0)).alias("trip_distance"),
        (F.col("value") * F.lit(0.8) - F.lit(1.0)).alias("fare_amount"),
        F.col("value").alias("total_amount"),
        payment.alias("payment_type"),
        taxi_type.alias("taxi_type"),
    )


def ride_feeds(spark: SparkSession, sf_dir: str, months: int = 1) -> dict[str, DataFrame]:
    """The rides of each feed, delivered twice, as raw monthly files hold them.

    The feeds disagree on a type: hired cars give the payment type as a double.
    With ``months``, the pickups are dealt over so many months by vendor.
    """
    trips = delivered_twice(rides(spark, sf_dir))
    if months > 1:
        later = F.make_ym_interval(F.lit(0), (F.col("vendor_id") % months).cast("int"))
        trips = trips.withColumn("pickup_datetime", F.col("pickup_datetime") + later)
    feeds = {name: as_feed(trips, name) for name in FEED_NAMES}
    feeds["hired"] = feeds["hired"].withColumn("payment_type", F.col("payment_type").cast("double"))
    return feeds


def write_monthly(feed: DataFrame, taxi_type: str, pickup: str, root: str) -> None:
    """Land a raw feed as ``taxi_type=/year=/month=`` Parquet directories."""
    (
        feed.withColumns(
            {
                "taxi_type": F.lit(taxi_type),
                "year": F.date_format(pickup, "yyyy"),
                "month": F.date_format(pickup, "MM"),
            }
        )
        .hint("rebalance", "year", "month")
        .write.mode("append")
        .partitionBy("taxi_type", "year", "month")
        .parquet(root)
    )


def write_ride_months(
    spark: SparkSession,
    sf_dir: str,
    root: str,
    without: str | None = None,
    months: int = 1,
    only: str | None = None,
) -> str:
    """Land the rides of all feeds, but for those of one day if it is named, or those of one day alone."""
    for taxi_type, feed in ride_feeds(spark, sf_dir, months).items():
        pickup = FEED_NAMES[taxi_type].get("pickup_datetime", "pickup_datetime")
        if without is not None:
            feed = feed.filter(F.to_date(pickup) != F.lit(without).cast("date"))
        if only is not None:
            feed = feed.filter(F.to_date(pickup) == F.lit(only).cast("date"))
        write_monthly(feed, taxi_type, pickup, root)
    return root


def hourly_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cleaned trips with their pickup date and hour."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.to_date("ts").alias("pickup_date"),
        F.hour("ts").alias("pickup_hour"),
        (F.col("value") * F.lit(0.8)).alias("fare_amount"),
        F.col("value").alias("total_amount"),
        _k().cast("double").alias("trip_distance"),
        F.col("event_type").alias("payment_type"),
    )


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signup events of each hour as that hour's weather.

    Not every hour has one, so some trips find no reading.
    """
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "signup")
        .groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"))
        .agg(
            rounded(F.avg("value")).alias("temperature_2m"),
            F.round(F.sum("value"), 2).alias("precipitation"),
            F.count("value").cast("double").alias("windspeed_10m"),
        )
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one reading of its hour: many readings per hour."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.col("value").alias("temperature_2m"),
        _k().cast("double").alias("precipitation"),
        F.col("user_id").cast("double").alias("windspeed_10m"),
    )


def reading_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly readings as one nested document per day.

    Weekend documents use the older wind field and leave the newer one empty.
    Monday documents lost their temperatures after the twelfth reading.
    """
    # at most 24 entries per day
    entries = F.array_sort(
        F.collect_list(F.struct("hour", "temperature_2m", "precipitation", "windspeed_10m"))
    )
    days = hourly_readings(spark, sf_dir).groupBy("date").agg(entries.alias("e"))
    time = F.transform(
        "e", lambda x: F.format_string("%sT%02d:00", F.col("date").cast("string"), x["hour"])
    )
    temperature, rain, wind = (
        F.col("e")[m].cast("array<string>")
        for m in ("temperature_2m", "precipitation", "windspeed_10m")
    )
    none = F.array().cast("array<string>")
    weekend = F.dayofweek("date").isin(1, 7)
    monday = F.dayofweek("date") == 2
    return days.select(
        F.struct(
            time.alias("time"),
            F.when(monday, F.slice(temperature, 1, 12)).otherwise(temperature).alias("temperature_2m"),
            rain.alias("precipitation"),
            F.when(weekend, none).otherwise(wind).alias("wind_speed_10m"),
            F.when(weekend, wind).alias("windspeed_10m"),
        ).alias("hourly"),
        "date",
    )


def write_documents(documents: DataFrame, root: str) -> str:
    """One JSON file per day below ``date=``."""
    documents.write.mode("append").partitionBy("date").json(root)
    return root


def trip_columns() -> list[str]:
    return [f.name for f in TRIP_FIELDS] + ["taxi_type"]
