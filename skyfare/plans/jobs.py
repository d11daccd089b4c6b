"""The pipeline's jobs and their order, all on the caller's one session."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Mapping
from datetime import date
from typing import Any, Literal, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyfare import schemas
from skyfare.operators.conform import (
    clean_conformed,
    conform_trips,
    missing_required,
    union_feeds,
)
from skyfare.operators.enrich import broadcast_fits, enrich_trips
from skyfare.operators.metrics import daily_metrics
from skyfare.operators.quality import Measured, quality_report, require_quality
from skyfare.operators.readings import flatten_readings, normalize_readings
from skyfare.sources import journal
from skyfare.sources.files import partition_values, table_bytes
from skyfare.sources.landing import land_missing_months, land_new_days
from skyfare.sources.settings import sized_shuffles
from skyfare.sources.tables import (
    drop_emptied_partitions,
    scan_if_exists,
    scan_layer,
    scan_raw_trips,
    scan_reading_documents,
    scan_units,
    write_layer,
)
from skyfare.sources.zones import files_of_window

Replace = Literal["table", "partitions"]

# The names by which a run can skip steps, in running order.
STEPS = (
    "bronze_tlc",
    "bronze_weather",
    "silver_trips",
    "silver_weather",
    "silver_enriched",
    "gold_daily_metrics",
    "quality",
)


# The folder of each table below the root.
RAW_TRIPS = "bronze/tlc"
RAW_READINGS = "bronze/weather"
TRIPS = "silver/trips"
READINGS = "silver/weather"
ENRICHED = "silver/enriched_trips"
DAILY = "gold/daily_metrics"


class Layout:
    """Where the tables live below one root folder."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.raw_trips = f"{self.root}/{RAW_TRIPS}"
        self.raw_readings = f"{self.root}/{RAW_READINGS}"
        self.trips = f"{self.root}/{TRIPS}"
        self.readings = f"{self.root}/{READINGS}"
        self.enriched = f"{self.root}/{ENRICHED}"
        self.daily = f"{self.root}/{DAILY}"


def build_trips(
    spark: SparkSession,
    source: str,
    target: str,
    taxi_types: Iterable[str] | None = None,
    first_month: str | None = None,
    last_month: str | None = None,
    replace: Replace = "table",
    first_day: str | None = None,
    last_day: str | None = None,
    measured: Measured | None = None,
    days: Collection[str] | None = None,
) -> str:
    """Raw months of all wanted feeds to the clean trip table, of all pickup days or of a window.

    The whole table is replaced, other feeds included, unless ``replace`` is
    ``"partitions"``: then other feeds (those not wanted, or without raw files)
    and days outside the window stay, and days of the window that have no trip
    any more go. That mode takes all months: a monthly file also holds trips of
    days outside its month, so a few months cannot stand for the days they
    touch. Of their files, only those are opened whose zone meets the window
    (see ``zones``); files without a zone are. Where files hold real timestamps
    the window reaches the scan as well, which skips row groups of other days. A
    month whose files lack a column that cleaning needs is an error: all of its
    rows would vanish. ``days`` narrows the window to single days. A replacement
    that an earlier job left undone is done first (see ``journal``).
    """
    if replace == "partitions" and (first_month or last_month):
        raise ValueError("replacing partitions takes all months of a feed")
    feeds = None if taxi_types is None else list(taxi_types)
    if replace == "table":
        frames = scan_raw_trips(spark, source, feeds, first_month, last_month)
        _write_trips(spark, source, frames, target, replace, _Window(first_day, last_day, days), measured)
        return target
    window = _Window(first_day, last_day, days)
    feeds, frames = _frames_of_window(spark, source, feeds, window)

    def again(noted: dict[str, Any]) -> None:
        past = _Window(*noted["window"])
        named, scans = _frames_of_window(spark, noted["source"], noted["feeds"], past)
        _replace_trips(spark, noted["source"], named, scans, target, past)

    with journal.resumed(spark, target, {"source": source, "feeds": feeds, "window": window}, again):
        _replace_trips(spark, source, feeds, frames, target, window, measured)
    return target


def _frames_of_window(
    spark: SparkSession, source: str, feeds: list[str] | None, window: _Window
) -> tuple[list[str], list[DataFrame]]:
    """The feeds to replace, and scans of their raw files that may hold trips of the window."""
    files = files_of_window(spark, source, None, None)
    if files is None or "taxi_type" not in files.columns:
        raise FileNotFoundError(f"no trip files under {source}")
    there = sorted(r.taxi_type for r in files.select("taxi_type").distinct().collect())
    feeds = there if feeds is None else feeds
    if not set(feeds) & set(there):
        raise FileNotFoundError(f"no trip files of {feeds} under {source}")
    wanted = files_of_window(spark, source, *window).filter(F.col("taxi_type").isin(feeds))
    frames = scan_units(spark, source, wanted, by_file=True)
    _require_columns(source, frames)
    return feeds, frames


def _require_columns(source: str, frames: list[DataFrame]) -> None:
    for frame in frames:
        absent = missing_required(frame)
        if absent:
            raise ValueError(f"raw trips under {source} lack {absent}, columns are {frame.columns}")


def _write_trips(
    spark: SparkSession,
    source: str,
    frames: list[DataFrame],
    target: str,
    replace: Replace,
    window: _Window,
    measured: Measured | None = None,
    written: Observation | None = None,
) -> None:
    _require_columns(source, frames)

    def observed(df: DataFrame) -> DataFrame:
        if written is not None:
            # one entry for each day and feed of the window
            df = df.observe(written, F.collect_set(F.struct(*schemas.TRIPS_PARTITIONS)).alias("partitions"))
        return df if measured is None else measured.attach(df)

    conformed = union_feeds([conform_trips(frame, F.col("taxi_type")) for frame in frames])
    first, last = window.bounds()
    if first is not None:
        conformed = conformed.filter(F.col("pickup_datetime") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        after = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
        conformed = conformed.filter(F.col("pickup_datetime") < after)
    if window.days is not None:
        conformed = conformed.filter(window.holds(F.to_date("pickup_datetime")))
    with sized_shuffles(spark, table_bytes(spark, source)):
        write_layer(clean_conformed(conformed), target, schemas.TRIPS_PARTITIONS, replace, observed=observed)


def _replace_trips(
    spark: SparkSession,
    source: str,
    feeds: list[str],
    frames: list[DataFrame],
    target: str,
    window: _Window,
    measured: Measured | None = None,
) -> None:
    written = Observation()
    if frames:
        _write_trips(spark, source, frames, target, "partitions", window, measured, written)
    partitions = [tuple(map(str, r)) for r in written.get["partitions"]] if frames else []
    kept = spark.createDataFrame(partitions, ", ".join(f"{name} string" for name in schemas.TRIPS_PARTITIONS))
    wanted = window.holds(F.col("pickup_date").try_cast("date")) & F.col("taxi_type").isin(feeds)
    drop_emptied_partitions(spark, target, kept, wanted)


def build_readings(
    spark: SparkSession,
    documents: DataFrame,
    target: str,
    replace: Replace = "table",
    first_day: str | None = None,
    last_day: str | None = None,
    days: Collection[str] | None = None,
) -> str:
    """Reading documents to the typed hourly table, of all days or of a window; no reading at all is an error.

    ``days`` narrows the window to single days. A replacement that an earlier
    job left undone is done first, from these documents.
    """
    rows = flatten_readings(documents)
    if rows.isEmpty():
        raise FileNotFoundError("the reading documents hold no reading")

    def build(window: _Window) -> None:
        readings = normalize_readings(rows).filter(window.holds(F.col("date")))
        write_layer(readings, target, schemas.READINGS_PARTITIONS, replace)
        if replace == "partitions":
            _drop_emptied_days(spark, target, readings.select("date"), window)

    _resumed_days(spark, target, replace, {}, _Window(first_day, last_day, days), lambda _, window: build(window))
    return target


def build_enriched(
    spark: SparkSession,
    trips: str,
    readings: str,
    target: str,
    first_day: str | None = None,
    last_day: str | None = None,
    replace: Replace = "table",
    measured: Measured | None = None,
    days: Collection[str] | None = None,
) -> str:
    """Clean trips and hourly readings to enriched trips, of all days or of a window.

    Trips come off a table that is already partitioned by day, and a broadcast
    join leaves them where they are, so they are written as they lie. Only the
    shuffle join beyond the broadcast bound has to gather the days again. With
    ``replace="partitions"``, days of the window that have no trip any more go.
    ``days`` narrows the window to single days. A replacement that an earlier
    job left undone is done first.
    """

    def build(paths: Mapping[str, str], window: _Window) -> None:
        trip_table = scan_layer(spark, paths["trips"], schemas.TRIPS).filter(window.holds(F.col("pickup_date")))
        reading_table = scan_layer(spark, paths["readings"], schemas.READINGS).filter(window.holds(F.col("date")))
        unmoved = broadcast_fits(reading_table)
        with sized_shuffles(spark, table_bytes(spark, paths["trips"])):
            enriched = enrich_trips(trip_table, reading_table, broadcast_readings=unmoved)
            write_layer(
                enriched, target, schemas.ENRICHED_PARTITIONS, replace, not unmoved, measured and measured.attach
            )
        if replace == "partitions":
            _drop_emptied_days(spark, target, partition_values(spark, paths["trips"], "pickup_date"), window)

    paths = {"trips": trips, "readings": readings}
    _resumed_days(spark, target, replace, paths, _Window(first_day, last_day, days), build)
    return target


def build_daily(
    spark: SparkSession,
    enriched: str,
    target: str,
    first_day: str | None = None,
    last_day: str | None = None,
    replace: Replace = "table",
    measured: Measured | None = None,
    days: Collection[str] | None = None,
) -> str:
    """Enriched trips to the daily table, of all days or of a window.

    With ``replace="partitions"``, days of the window that have no trip any more
    go. ``days`` narrows the window to single days. A replacement that an
    earlier job left undone is done first.
    """

    def build(paths: Mapping[str, str], window: _Window) -> None:
        trips = scan_layer(spark, paths["enriched"], schemas.ENRICHED)
        metrics = daily_metrics(trips.filter(window.holds(F.col("pickup_date"))))
        write_layer(metrics, target, schemas.DAILY_PARTITIONS, replace, observed=measured and measured.attach)
        if replace == "partitions":
            stored = partition_values(spark, paths["enriched"], "pickup_date")
            _drop_emptied_days(spark, target, stored.withColumnRenamed("pickup_date", "date"), window)

    _resumed_days(spark, target, replace, {"enriched": enriched}, _Window(first_day, last_day, days), build)
    return target


class _Window(NamedTuple):
    """An inclusive window of days that may be open at either end, or single days of it."""

    first: str | None = None
    last: str | None = None
    days: Collection[str] | None = None

    def bounds(self) -> tuple[str | None, str | None]:
        """The first and last day that can be in it."""
        if not self.days:
            return self.first, self.last
        return max(filter(None, (self.first, min(self.days)))), min(filter(None, (self.last, max(self.days))))

    def holds(self, day: Column) -> Column:
        inside = F.lit(True)
        if self.first is not None:
            inside &= day >= F.lit(self.first).cast("date")
        if self.last is not None:
            inside &= day <= F.lit(self.last).cast("date")
        if self.days is not None:
            inside &= day.isin([date.fromisoformat(own) for own in self.days])
        return inside


def _resumed_days(
    spark: SparkSession,
    target: str,
    replace: Replace,
    paths: Mapping[str, str],
    window: _Window,
    build: Callable[[Mapping[str, str], _Window], None],
) -> None:
    """A table whole, or a window of it after what earlier jobs left undone."""
    if replace == "table":
        build(paths, window)
        return

    def again(noted: dict[str, Any]) -> None:
        build(noted["paths"], _Window(*noted["window"]))

    with journal.resumed(spark, target, {"paths": paths, "window": window}, again):
        build(paths, window)


def _drop_emptied_days(spark: SparkSession, target: str, kept: DataFrame, window: _Window) -> None:
    """Remove the days of a window that are not in ``kept``, whose one column is the table's day."""
    day = F.col(kept.columns[0]).try_cast("date")
    drop_emptied_partitions(spark, target, kept, window.holds(day))


def check_layers(
    spark: SparkSession, layout: Layout, measured: Mapping[str, Measured] | None = None
) -> DataFrame:
    """The standard quality report on the tables as they are stored.

    The tables are read by the schema of their files: a declared schema would
    show a column that is missing there as NULLs. A table in ``measured`` has
    been written whole with these measures taken, so only its uniqueness rules
    read it again.
    """
    return quality_report(
        spark,
        {
            "silver.trips": scan_if_exists(spark, layout.trips),
            "silver.enriched_trips": scan_if_exists(spark, layout.enriched),
            "gold.daily_metrics": scan_if_exists(spark, layout.daily),
        },
        measured=measured,
    )


def require_layers(spark: SparkSession, layout: Layout, measured: Mapping[str, Measured] | None = None) -> None:
    """The quality gate on the stored tables; the uniqueness rule shuffles every trip's key."""
    with sized_shuffles(spark, table_bytes(spark, layout.trips)):
        require_quality(check_layers(spark, layout, measured))


def run_pipeline(
    spark: SparkSession,
    layout: Layout,
    *,
    landing_trips: str,
    landing_readings: str,
    taxi_type: str,
    start_month: str,
    end_month: str,
    start_date: str,
    end_date: str,
    today: str,
    skip_steps: Collection[str] = (),
    raw_readings_format: Literal["parquet", "json"] = "parquet",
    replace: Replace = "table",
    first_day: str | None = None,
    last_day: str | None = None,
) -> list[str]:
    """All steps in order but the skipped ones; returns the names of those that ran.

    By default every table is replaced. With ``replace="partitions"`` only the
    days from ``first_day`` to ``last_day`` are built anew, in all tables; trips
    of other feeds and of other days stay, and days without rows go. Such a run
    that dies between two tables is noted (see ``journal``): the next one, of
    whatever window or feed, first takes its days through all tables.

    A skipped step leaves its table as an earlier run wrote it. The two landing
    steps copy from the landing folders; ``raw_readings_format="json"`` serves a
    folder of raw documents that something else filled. A failed quality rule
    stops the run with a RuntimeError.
    """
    unknown = set(skip_steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}, steps are {STEPS}")

    def documents() -> DataFrame:
        if raw_readings_format == "json":
            return scan_reading_documents(spark, layout.raw_readings)
        landed = scan_if_exists(spark, layout.raw_readings, schemas.LANDED_DOCUMENT)
        if landed is None:
            raise FileNotFoundError(f"no landed reading documents under {layout.raw_readings}")
        return landed

    if replace == "table" and (first_day or last_day):
        raise ValueError('a window of days is built with replace="partitions"')
    window = {"replace": replace, "first_day": first_day, "last_day": last_day}
    # a whole table is measured as it is written; one that keeps other days is scanned
    layers = {"silver_trips": "silver.trips", "silver_enriched": "silver.enriched_trips", "gold_daily_metrics": "gold.daily_metrics"}
    measured = {
        table: Measured(table) for step, table in layers.items() if replace == "table" and step not in skip_steps
    }
    landing = {
        "bronze_tlc": lambda: land_missing_months(
            spark, landing_trips, layout.raw_trips, taxi_type, start_month, end_month
        ),
        "bronze_weather": lambda: land_new_days(
            spark, landing_readings, layout.raw_readings, start_date, end_date, today
        ),
    }

    def builders(feed: str, measured: Mapping[str, Measured], **window: Any) -> dict[str, Callable[[], object]]:
        return {
            "silver_trips": lambda: build_trips(
                spark, layout.raw_trips, layout.trips, [feed], measured=measured.get("silver.trips"), **window
            ),
            "silver_weather": lambda: build_readings(spark, documents(), layout.readings, **window),
            "silver_enriched": lambda: build_enriched(
                spark, layout.trips, layout.readings, layout.enriched, measured=measured.get("silver.enriched_trips"), **window
            ),
            "gold_daily_metrics": lambda: build_daily(
                spark, layout.enriched, layout.daily, measured=measured.get("gold.daily_metrics"), **window
            ),
        }

    def again(noted: dict[str, Any]) -> None:
        past = builders(noted["feed"], {}, replace=replace, first_day=noted["first_day"], last_day=noted["last_day"])
        for step in noted["steps"]:
            past[step]()

    executed = [step for step in STEPS if step not in skip_steps]
    tables = builders(taxi_type, measured, **window)
    building = [step for step in executed if step in tables]
    for step in executed:
        if step in landing:
            landing[step]()
    if replace == "partitions" and building:
        noted = {"feed": taxi_type, "first_day": first_day, "last_day": last_day, "steps": building}
        built: list[str] = []
        with journal.resumed(spark, layout.root, noted, again, untouched=lambda: not built):
            for step in building:
                tables[step]()
                built.append(step)
    else:
        for step in building:
            tables[step]()
    if "quality" in executed:
        require_layers(spark, layout, measured)
    return executed
