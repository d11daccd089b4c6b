"""One query per operator, each over the whole of the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare import schemas
from skyfare.functions.arrays import first_filled, item_or_null
from skyfare.functions.measures import price_per_distance
from skyfare.functions.parsing import READING_TIME_FORMATS, wall_clock
from skyfare.operators import conform, enrich, inspect, metrics, quality, readings
from skyfare.operators import footer_profile as footers
from skyfare.plans import jobs
from skyfare.registry import inputs
from skyfare.sources import buckets, files, journal, landing, plans, tables, zones
from skyfare.sources.scratch import scratch_path
from skyfare.streaming import readings as reading_stream
from skyfare.streaming import touched

PROFILED = ("passenger_count", "trip_distance", "fare_amount", "pu_location_id", "pickup_date", "taxi_type")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query; dates and timestamps leave it as text, which all engines print alike."""

    def portable(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        clocks = (T.DateType, T.TimestampNTZType, T.TimestampType)
        return df.select(
            *[
                F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, clocks) else F.col(f.name)
                for f in df.schema
            ]
        )

    QUERIES[build.__name__] = portable
    return build


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: inputs.rounded(F.col(name)) for name in names})


def _map_as_text(df: DataFrame) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("payment_type_counts")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return df.withColumn("payment_type_counts", F.array_join(entries, ","))


def _daily(df: DataFrame) -> DataFrame:
    return _map_as_text(
        _rounded(
            df,
            "avg_fare_amount",
            "avg_total_amount",
            "avg_trip_distance",
            "surge_proxy",
            "avg_temp",
            "total_precip",
        )
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_trips(inputs.hourly_trips(spark, sf_dir), inputs.hourly_readings(spark, sf_dir))


def _conformed_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = inputs.delivered_twice(inputs.rides(spark, sf_dir))
    return conform.conform_trips(rides, F.col("taxi_type"))


# --- projections and scalar expressions


@query
def conform_columns(spark, sf_dir):
    """Each feed's vendor, pickup place and passengers under whichever name it has."""
    picked = [
        feed.select(
            F.lit(name).alias("taxi_type"),
            *[
                conform.pick_column(feed, *f.raw_names).cast("int").alias(f.name)
                for f in schemas.TRIP_FIELDS
                if f.name in ("vendor_id", "pu_location_id", "passenger_count")
            ],
        )
        for name, feed in inputs.shipped_feeds(spark, sf_dir).items()
    ]
    return conform.union_feeds(picked)


@query
def conform_trips(spark, sf_dir):
    return conform.conform_feeds(inputs.shipped_feeds(spark, sf_dir))


@query
def union_trip_types(spark, sf_dir):
    """The raw feeds in one table; a column that a feed lacks is NULL there."""
    feeds = inputs.shipped_feeds(spark, sf_dir)
    return conform.union_feeds([feed.withColumn("taxi_type", F.lit(name)) for name, feed in feeds.items()])


def _clock_text(layout):
    """Event times as text in ``layout``; errors have no readable time, or one without a date."""
    kind = F.col("event_id") % 5
    unreadable = (
        F.when(kind == 0, "n/a")
        .when(kind == 1, F.date_format("ts", "'T'HH"))
        .when(kind == 2, F.concat(F.lit("\x01"), F.date_format("ts", "HH:mm")))
        .when(kind == 3, F.date_format("ts", "'T'HH:mm"))
        .otherwise(F.date_format("ts", "HH:mm"))
    )
    return F.when(F.col("event_type") == "error", unreadable).otherwise(layout)


@query
def parse_timestamps(spark, sf_dir):
    text = _clock_text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", wall_clock(text, T.StringType()).alias("parsed")
    )


@query
def parse_timestamps_multi(spark, sf_dir):
    kind = F.col("event_type")
    text = _clock_text(
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
        .when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", wall_clock(text, T.StringType(), READING_TIME_FORMATS).alias("parsed")
    )


@query
def derive_date_hour(spark, sf_dir):
    times = inputs.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("pickup_datetime"))
    return conform.with_pickup_calendar(times).drop("pickup_datetime")


@query
def normalize_readings(spark, sf_dir):
    """Events as untyped readings; those with an unreadable time drop."""
    raw = inputs.table(spark, sf_dir, "events").select(
        _clock_text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("timestamp"),
        F.col("value").cast("string").alias("temperature_2m"),
        F.get_json_object("props", "$.k").alias("precipitation"),
        F.col("event_type").alias("windspeed_10m"),
    )
    return readings.normalize_readings(raw)


@query
def array_safe_get(spark, sf_dir):
    temperature = F.col("hourly.temperature_2m")
    return inputs.reading_documents(spark, sf_dir).select(
        "date",
        *[
            item_or_null(temperature, F.lit(i)).cast("double").alias(f"reading_{i}")
            for i in (0, 11, 12, 23, 24)
        ],
    )


@query
def field_fallback(spark, sf_dir):
    wind = first_filled(F.col("hourly.wind_speed_10m"), F.col("hourly.windspeed_10m"))
    return inputs.reading_documents(spark, sf_dir).select(
        "date", F.size(wind).alias("readings"), F.get(wind, 0).cast("double").alias("first_wind")
    )


@query
def flatten_readings(spark, sf_dir):
    rows = readings.flatten_readings(inputs.reading_documents(spark, sf_dir))
    return rows.select("timestamp", *[F.col(m).cast("double").alias(m) for m in schemas.READING_MEASURES])


@query
def guarded_ratio(spark, sf_dir):
    distance = F.when(F.col("payment_type") != "error", F.col("trip_distance"))
    return inputs.hourly_trips(spark, sf_dir).select(
        "event_id", price_per_distance(F.col("total_amount"), distance).alias("ratio")
    )


# --- filters and deduplication


@query
def filter_valid_times(spark, sf_dir):
    return conform.with_valid_times(_conformed_rides(spark, sf_dir))


@query
def filter_non_negative(spark, sf_dir):
    trips = conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type"))
    return conform.with_valid_measures(trips)


@query
def dedupe_trips(spark, sf_dir):
    return conform.dedupe_trips(
        conform.conform_trips(
            inputs.delivered_twice(inputs.shipped_trips(spark, sf_dir)), F.col("taxi_type")
        )
    )


@query
def dedupe_hours(spark, sf_dir):
    return readings.dedupe_hours(inputs.event_readings(spark, sf_dir))


@query
def clean_trips(spark, sf_dir):
    """Three feeds with different names, cleaned with one shuffle for all of them."""
    return conform.clean_conformed(conform.conform_feeds(inputs.shipped_feeds(spark, sf_dir)))


# --- join and aggregates


@query
def enrich_hourly(spark, sf_dir):
    return _enriched(spark, sf_dir)


@query
def enrich_hourly_shuffled(spark, sf_dir):
    """The join beyond the broadcast bound: salted, and with the same result."""
    trips = inputs.hourly_trips(spark, sf_dir)
    return enrich.enrich_trips(trips, inputs.hourly_readings(spark, sf_dir), broadcast_readings=False)


@query
def enrich_hourly_heavy(spark, sf_dir):
    """The same with busy hours, a third of all trips being in one of them."""
    trips = inputs.hourly_trips(spark, sf_dir)
    busy = F.col("event_id") % 3 == 0
    trips = trips.withColumns(
        {
            "pickup_date": F.when(busy, F.lit("2024-01-05").cast("date")).otherwise(F.col("pickup_date")),
            "pickup_hour": F.when(busy, 9).otherwise(F.col("pickup_hour")),
        }
    )
    readings = inputs.hourly_readings(spark, sf_dir)
    return enrich.enrich_trips(trips, readings, broadcast_readings=False, trips_per_salt=50)


@query
def daily_trip_metrics(spark, sf_dir):
    days = metrics.daily_trip_metrics(inputs.hourly_trips(spark, sf_dir))
    return _rounded(days, "avg_fare_amount", "avg_total_amount", "avg_trip_distance", "surge_proxy")


@query
def payment_counts(spark, sf_dir):
    trips = conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type"))
    return metrics.payment_counts(conform.with_pickup_calendar(trips))


@query
def payment_map(spark, sf_dir):
    trips = conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type"))
    return _map_as_text(metrics.payment_map(metrics.payment_counts(conform.with_pickup_calendar(trips))))


@query
def daily_readings(spark, sf_dir):
    return _rounded(metrics.daily_readings(_enriched(spark, sf_dir)), "avg_temp", "total_precip")


@query
def daily_metrics(spark, sf_dir):
    return _daily(metrics.daily_metrics(_enriched(spark, sf_dir)))


@query
def daily_metrics_unmatched(spark, sf_dir):
    """Shipped trips long before the readings: no day has weather, and Sundays no payment type."""
    trips = conform.clean_conformed(conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type")))
    paid = F.when(F.dayofweek("pickup_date") != 1, F.col("payment_type"))
    trips = trips.withColumn("payment_type", paid)
    return _daily(metrics.daily_metrics(enrich.enrich_trips(trips, inputs.hourly_readings(spark, sf_dir))))


@query
def daily_no_payment(spark, sf_dir):
    return _daily(metrics.daily_metrics(_enriched(spark, sf_dir).drop("payment_type")))


# --- data quality


@query
def quality_row_count(spark, sf_dir):
    rules = {name: [quality.NonEmpty()] for name in ("lineitem", "orders", "events", "unmatched")}
    found = {name: inputs.table(spark, sf_dir, name) for name in ("lineitem", "orders", "events")}
    lines, orders = found["lineitem"], found["orders"]
    found["unmatched"] = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti")
    return quality.quality_report(spark, found, rules)


@query
def not_null_rate(spark, sf_dir):
    trips = conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type"))
    rules = [
        quality.NotNullRate(columns=("pickup_datetime",), threshold=0.999),
        quality.NotNullRate(columns=("payment_type",), threshold=0.999),
        quality.NotNullRate(columns=("tip_amount",), threshold=0.5),
    ]
    return quality.check_table(trips, "trips", rules)


@query
def value_ranges(spark, sf_dir):
    trips = conform.conform_trips(inputs.shipped_trips(spark, sf_dir), F.col("taxi_type"))
    rules = [
        *quality.value_range("trip_distance", low=0.0, high=40.0),
        *quality.value_range("fare_amount", low=0.0, high=100000.0),
        *quality.value_range("tip_amount", low=0.0, high=9.0),
        *quality.value_range("toll_amount"),
    ]
    return quality.check_table(trips, "trips", rules)


@query
def uniqueness_ratio(spark, sf_dir):
    rules = [
        quality.UniqueRatio(columns=("l_orderkey", "l_linenumber"), threshold=0.995),
        quality.UniqueRatio(columns=("l_orderkey", "l_batch"), threshold=0.995),
        quality.UniqueRatio(columns=("l_suppkey", "l_linenumber"), threshold=0.995),
    ]
    return quality.check_table(inputs.table(spark, sf_dir, "lineitem"), "lineitem", rules)


def _clean_rides(spark, sf_dir):
    return conform.clean_conformed(_conformed_rides(spark, sf_dir))


@query
def uniqueness_in_buckets(spark, sf_dir):
    """Distinct trip keys of a table in buckets, counted where they lie."""
    name, path = f"trips_{uuid.uuid4().hex}", scratch_path(spark, "bucketed-trips")
    by = ("vendor_id", "pickup_datetime")
    trips = buckets.write_buckets(_clean_rides(spark, sf_dir), name, path, schemas.TRIPS_PARTITIONS, by, 8)
    rules = [
        quality.UniqueRatio(columns=schemas.TRIP_KEY, threshold=0.995),
        quality.UniqueRatio(columns=by, threshold=0.995),
        quality.UniqueRatio(columns=(*by, "trip_distance"), threshold=0.5),
    ]
    months = buckets.month_slices(files.list_partitions(spark, path), "pickup_date")
    return _rounded(quality.check_table(trips, "trips", rules, apart=months), "observed")


@query
def quality_report(spark, sf_dir):
    """The standard rules on the stored tables of all rides."""
    layout = _build_enriched(spark, sf_dir, "quality")
    jobs.build_daily(spark, layout.enriched, layout.daily)
    return _rounded(jobs.check_layers(spark, layout), "observed")


@query
def quality_on_write(spark, sf_dir):
    """The same report, its rules measured while the tables are written; uniqueness is scanned."""
    layout = _raw_layers(spark, sf_dir, "measured")
    measured = {name: quality.Measured(name) for name in quality.STANDARD_RULES}
    jobs.build_trips(spark, layout.raw_trips, layout.trips, measured=measured["silver.trips"])
    documents = tables.scan_reading_documents(spark, layout.raw_readings)
    jobs.build_readings(spark, documents, layout.readings)
    enriched = measured["silver.enriched_trips"]
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched, measured=enriched)
    jobs.build_daily(spark, layout.enriched, layout.daily, measured=measured["gold.daily_metrics"])
    return _rounded(jobs.check_layers(spark, layout, measured), "observed")


@query
def quality_missing_table(spark, sf_dir):
    """The report on a root where only the trip table has been written."""
    layout = jobs.Layout(scratch_path(spark, "missing-table"))
    tables.write_layer(_clean_rides(spark, sf_dir), layout.trips, schemas.TRIPS_PARTITIONS)
    return jobs.check_layers(spark, layout)


# --- plans and landing


def _order_window(spark, sf_dir):
    dates = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    return dates.agg(F.min("d").alias("start"), F.max("d").alias("end"))


def _event_window(spark, sf_dir):
    dates = inputs.table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"))
    return dates.agg(F.min("d").alias("start"), F.max("d").alias("end"))


@query
def plan_months(spark, sf_dir):
    return plans.plan_months(_order_window(spark, sf_dir))


@query
def plan_days(spark, sf_dir):
    return plans.plan_days(_event_window(spark, sf_dir))


@query
def plan_incremental(spark, sf_dir):
    """Days of the order window that come after the last event."""
    landed = inputs.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"))
    window = _event_window(spark, sf_dir).select("start", F.date_add("end", 30).alias("end"))
    return plans.plan_incremental(window, landed, "2024-02-20")


@query
def plan_gaps(spark, sf_dir):
    """Days of the order window on which nothing was ordered."""
    landed = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    window = _order_window(spark, sf_dir).select("start", F.date_add("end", 10).alias("end"))
    return plans.plan_gaps(window, landed, "2024-02-20")


@query
def plan_manifest(spark, sf_dir):
    months = plans.plan_months(_order_window(spark, sf_dir))
    return plans.plan_manifest(months, "yellow", f"landing/{plans.FILE_NAME}", "bronze/tlc")


@query
def land_missing_months(spark, sf_dir):
    """Land half the yellow months, then all of them, then all of them again."""
    root = scratch_path(spark, "months")
    feed = inputs.shipped_feeds(spark, sf_dir)["yellow"]
    inputs.write_monthly(feed, "yellow", "tpep_pickup_datetime", f"{root}/landing")
    window = feed.agg(
        F.date_format(F.min("tpep_pickup_datetime"), "yyyy-MM").alias("start"),
        F.date_format(F.max("tpep_pickup_datetime"), "yyyy-MM").alias("end"),
    ).first()
    runs = [
        landing.land_missing_months(spark, f"{root}/landing", f"{root}/bronze", "yellow", window.start, end)
        for end in ("1998-06", window.end, window.end)
    ]
    return (
        conform.union_feeds(tables.scan_raw_trips(spark, f"{root}/bronze"))
        .groupBy("taxi_type", "year", "month")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            inputs.rounded(F.sum("total_amount"), 2).alias("amount"),
        )
        .withColumn("landed_again", F.lit(len(runs[2])))
    )


@query
def land_incremental_days(spark, sf_dir):
    """Land the days up to the middle of January, then the rest, then once more."""
    root = scratch_path(spark, "days")
    inputs.write_documents(inputs.reading_documents(spark, sf_dir), f"{root}/landing")
    days = files.list_partitions(spark, f"{root}/landing").agg(
        F.min("date").alias("start"), F.max("date").alias("end")
    )
    window = days.first()
    runs = [
        landing.land_new_days(spark, f"{root}/landing", f"{root}/bronze", window.start, end, "2024-02-20")
        for end in ("2024-01-15", window.end, window.end)
    ]
    documents = tables.scan_layer(spark, f"{root}/bronze", schemas.LANDED_DOCUMENT)
    return documents.select(
        "date",
        F.col("provenance.fetched_for_date").alias("fetched_for_date"),
        F.size("hourly.time").alias("readings"),
        F.when(F.col("date").cast("string").isin(runs[0]), 1)
        .when(F.col("date").cast("string").isin(runs[1]), 2)
        .otherwise(3)
        .alias("run"),
    )


def _landed_by_stream(spark, sf_dir):
    """Stream weekday documents, run again, then stream the weekend ones too."""
    root = scratch_path(spark, "stream")
    documents = inputs.reading_documents(spark, sf_dir)
    weekend = F.dayofweek("date").isin(1, 7)

    def land():
        reading_stream.land_available(spark, f"{root}/landing", f"{root}/bronze", f"{root}/checkpoint")

    inputs.write_documents(documents.filter(~weekend), f"{root}/landing")
    land()
    land()
    inputs.write_documents(documents.filter(weekend), f"{root}/landing")
    land()
    return tables.scan_layer(spark, f"{root}/bronze", schemas.LANDED_DOCUMENT)


@query
def land_stream_rerun(spark, sf_dir):
    return readings.normalize_readings(readings.flatten_readings(_landed_by_stream(spark, sf_dir)))


@query
def tag_provenance(spark, sf_dir):
    root = inputs.write_documents(
        inputs.reading_documents(spark, sf_dir), scratch_path(spark, "documents")
    )
    tagged = landing.tag_provenance(tables.scan_reading_documents(spark, root))
    return tagged.select(
        "date",
        F.col("provenance.fetched_for_date").alias("fetched_for_date"),
        F.regexp_extract("provenance.endpoint", "/(date=[^/]*)/", 1).alias("folder"),
    )


# --- sources, sinks, inspection


@query
def scan_trips(spark, sf_dir):
    """Yellow and hired months only, read from a table that holds all feeds."""
    root = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "months"))
    frames = tables.scan_raw_trips(spark, root, ["yellow", "hired"], "2024-01", "2024-12")
    return conform.union_feeds([conform.conform_trips(f, F.col("taxi_type")) for f in frames])


@query
def scan_trips_window(spark, sf_dir):
    """Two months of all feeds, read from a table that holds four."""
    root = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "months"), months=4)
    frames = tables.scan_raw_trips(spark, root, first_month="2024-02", last_month="2024-03")
    return conform.union_feeds([conform.conform_trips(f, F.col("taxi_type")) for f in frames])


@query
def zone_map(spark, sf_dir):
    """First and last pickup of the landed months of all feeds, from the zones of their files."""
    root = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "zones"), months=4)
    zones.measure_zones(spark, root)
    place = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    months = zones.zone_map(spark, root).groupBy(place("taxi_type"), place("year"), place("month"))
    return months.agg(
        F.min("first_pickup").alias("first_pickup"), F.max("last_pickup").alias("last_pickup"), F.sum("rows").alias("rows")
    )


@query
def job_trips_window(spark, sf_dir):
    """Three days of all feeds out of four landed months, opening only files whose zone meets them."""
    root = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "months"), months=4)
    zones.measure_zones(spark, root)
    target = scratch_path(spark, "window")
    window = {"replace": "partitions", "first_day": "2024-01-08", "last_day": "2024-01-10"}
    jobs.build_trips(spark, root, target, **window)
    return tables.scan_layer(spark, target, schemas.TRIPS)


@query
def partition_values(spark, sf_dir):
    root = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "months"))
    return files.partition_values(spark, root, "taxi_type")


@query
def scan_readings(spark, sf_dir):
    root = inputs.write_documents(
        inputs.reading_documents(spark, sf_dir), scratch_path(spark, "documents")
    )
    hourly = F.col("hourly")
    return tables.scan_reading_documents(spark, root).select(
        "date",
        F.size(hourly["time"]).alias("times"),
        F.size(hourly["temperature_2m"]).alias("temperatures"),
        F.size(hourly["precipitation"]).alias("rains"),
        F.size(hourly["wind_speed_10m"]).alias("winds"),
        F.size(hourly["windspeed_10m"]).alias("old_winds"),
    )


@query
def sink_trips_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "trips")
    tables.write_layer(_clean_rides(spark, sf_dir), path, schemas.TRIPS_PARTITIONS)
    return tables.scan_layer(spark, path, schemas.TRIPS)


@query
def sink_readings_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "readings")
    typed = readings.normalize_readings(readings.flatten_readings(inputs.reading_documents(spark, sf_dir)))
    tables.write_layer(typed, path, schemas.READINGS_PARTITIONS)
    return tables.scan_layer(spark, path, schemas.READINGS)


@query
def partition_inventory(spark, sf_dir):
    """The first 20 day partitions of the written trip table."""
    path = scratch_path(spark, "trips")
    tables.write_layer(_clean_rides(spark, sf_dir), path, schemas.TRIPS_PARTITIONS)
    return files.partition_inventory(spark, path).select("partition")


@query
def table_profile(spark, sf_dir):
    return inspect.table_profile(inputs.table(spark, sf_dir, "events"))


@query
def footer_profile(spark, sf_dir):
    """Rows, values and ranges of the written trip table's columns, from its footers."""
    path = scratch_path(spark, "trips")
    tables.write_layer(_clean_rides(spark, sf_dir), path, schemas.TRIPS_PARTITIONS)
    profile = footers.footer_profile(spark, path).filter(F.col("column").isin(*PROFILED))
    number = {end: F.round(F.col(end).try_cast("double"), 6) for end in ("lowest", "highest")}
    return profile.select(
        "column",
        "rows",
        "filled",
        *[value.alias(f"{end}_number") for end, value in number.items()],
        *[F.when(value.isNull(), F.col(end)).alias(f"{end}_text") for end, value in number.items()],
    )


@query
def table_sample(spark, sf_dir):
    """The five most valuable events."""
    events = inputs.table(spark, sf_dir, "events")
    return inspect.sample_rows(events.withColumn("rank_value", -F.col("value")), ["rank_value", "event_id"])


# --- jobs


def _raw_layers(spark, sf_dir, label):
    """A layout whose raw tables hold all ride months and all reading documents."""
    layout = jobs.Layout(scratch_path(spark, label))
    inputs.write_ride_months(spark, sf_dir, layout.raw_trips)
    inputs.write_documents(inputs.reading_documents(spark, sf_dir), layout.raw_readings)
    return layout


@query
def job_trips(spark, sf_dir):
    layout = jobs.Layout(scratch_path(spark, "job-trips"))
    inputs.write_ride_months(spark, sf_dir, layout.raw_trips)
    jobs.build_trips(spark, layout.raw_trips, layout.trips)
    return tables.scan_layer(spark, layout.trips, schemas.TRIPS)


@query
def job_readings(spark, sf_dir):
    layout = jobs.Layout(scratch_path(spark, "job-readings"))
    inputs.write_documents(inputs.reading_documents(spark, sf_dir), layout.raw_readings)
    documents = tables.scan_reading_documents(spark, layout.raw_readings)
    jobs.build_readings(spark, documents, layout.readings)
    return tables.scan_layer(spark, layout.readings, schemas.READINGS)


def _build_enriched(spark, sf_dir, label):
    layout = _raw_layers(spark, sf_dir, label)
    jobs.build_trips(spark, layout.raw_trips, layout.trips)
    documents = tables.scan_reading_documents(spark, layout.raw_readings)
    jobs.build_readings(spark, documents, layout.readings)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched)
    return layout


@query
def job_enriched(spark, sf_dir):
    layout = _build_enriched(spark, sf_dir, "job-enriched")
    return tables.scan_layer(spark, layout.enriched, schemas.ENRICHED)


@query
def job_daily(spark, sf_dir):
    layout = _build_enriched(spark, sf_dir, "job-daily")
    jobs.build_daily(spark, layout.enriched, layout.daily)
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY))


@query
def job_incremental(spark, sf_dir):
    """All days, then three of them again from raw months that lost one day's trips."""
    layout = _build_enriched(spark, sf_dir, "job-incremental")
    jobs.build_daily(spark, layout.enriched, layout.daily)
    changed = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "changed"), without="2024-01-09")
    window = {"first_day": "2024-01-08", "last_day": "2024-01-10", "replace": "partitions"}
    jobs.build_trips(spark, changed, layout.trips, **window)
    jobs.build_enriched(spark, layout.trips, layout.readings, layout.enriched, **window)
    jobs.build_daily(spark, layout.enriched, layout.daily, **window)
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY))


@query
def job_incremental_one_feed(spark, sf_dir):
    """All feeds, then all steps of a window again from a source of one feed, which lost a day's trips."""
    layout = _build_enriched(spark, sf_dir, "job-one-feed")
    jobs.build_daily(spark, layout.enriched, layout.daily)
    changed = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "changed"), without="2024-01-09")
    window = _event_window(spark, sf_dir).first()
    only = jobs.Layout(layout.root)
    only.raw_trips = scratch_path(spark, "one-feed")
    jobs.run_pipeline(
        spark,
        only,
        landing_trips=changed,
        landing_readings=layout.raw_readings,
        taxi_type="yellow",
        start_month=f"{window.start:%Y-%m}",
        end_month=f"{window.end:%Y-%m}",
        start_date=window.start.isoformat(),
        end_date=window.end.isoformat(),
        today="2024-02-20",
        skip_steps=["bronze_weather"],
        raw_readings_format="json",
        replace="partitions",
        first_day="2024-01-08",
        last_day="2024-01-10",
    )
    # without naming the feed, the days of feeds that the source lacks stay too
    jobs.build_trips(
        spark, only.raw_trips, layout.trips, replace="partitions", first_day="2024-01-08", last_day="2024-01-10"
    )
    trips = tables.scan_layer(spark, layout.trips, schemas.TRIPS)
    by_day = trips.groupBy(F.col("pickup_date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("trips"))
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY)).withColumn("date", F.col("date").cast("string")).join(by_day, "date")


@query
def job_touched(spark, sf_dir):
    """Two landings, the second with one day's trips and the later documents; only the days they touch are rebuilt."""
    layout = jobs.Layout(scratch_path(spark, "job-touched"))
    checkpoint = scratch_path(spark, "touched")
    documents = inputs.reading_documents(spark, sf_dir)
    inputs.write_ride_months(spark, sf_dir, layout.raw_trips, without="2024-01-09")
    inputs.write_documents(documents.filter("date < DATE '2024-01-15'"), layout.raw_readings)
    touched.rebuild_touched(spark, layout, checkpoint, "json")
    inputs.write_ride_months(spark, sf_dir, layout.raw_trips, only="2024-01-09")
    inputs.write_documents(documents.filter("date >= DATE '2024-01-15'"), layout.raw_readings)
    touched.rebuild_touched(spark, layout, checkpoint, "json")
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY))


@query
def job_resumed(spark, sf_dir):
    """A window's run that was noted and died before its first write, then a run of another window."""
    layout = _build_enriched(spark, sf_dir, "job-resumed")
    jobs.build_daily(spark, layout.enriched, layout.daily)
    changed = jobs.Layout(layout.root)
    changed.raw_trips = inputs.write_ride_months(spark, sf_dir, scratch_path(spark, "changed"), without="2024-01-09")
    window = {"replace": "partitions", "skip_steps": ["bronze_tlc", "bronze_weather", "quality"]}
    steps = ["silver_trips", "silver_enriched", "gold_daily_metrics"]
    dead = {"feed": "yellow", "first_day": "2024-01-08", "last_day": "2024-01-10", "steps": steps}
    journal.begin(spark, layout.root, dead)
    jobs.run_pipeline(
        spark,
        changed,
        landing_trips="",
        landing_readings="",
        taxi_type="green",
        start_month="2024-01",
        end_month="2024-01",
        start_date="2024-01-01",
        end_date="2024-01-31",
        today="2024-02-20",
        raw_readings_format="json",
        first_day="2024-01-20",
        last_day="2024-01-20",
        **window,
    )
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY))


@query
def job_full(spark, sf_dir):
    """All seven steps for the yellow feed, from landing folders to the quality gate."""
    landed = _raw_layers(spark, sf_dir, "job-landing")
    layout = jobs.Layout(scratch_path(spark, "job-full"))
    window = _event_window(spark, sf_dir).first()
    jobs.run_pipeline(
        spark,
        layout,
        landing_trips=landed.raw_trips,
        landing_readings=landed.raw_readings,
        taxi_type="yellow",
        start_month=f"{window.start:%Y-%m}",
        end_month=f"{window.end:%Y-%m}",
        start_date=window.start.isoformat(),
        end_date=window.end.isoformat(),
        today="2024-02-20",
    )
    return _daily(tables.scan_layer(spark, layout.daily, schemas.DAILY))
