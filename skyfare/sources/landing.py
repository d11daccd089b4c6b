"""Rerun-safe landing of months of trips and days of readings, by plan.

Each function compares a plan with what the destination already holds, reads
only what is missing and replaces only those partitions, so a run that was cut
short can simply be started again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.sources.files import list_files, list_partitions
from skyfare.sources.plans import bounds, plan_gaps, plan_incremental, plan_months
from skyfare.sources.tables import UNIT_COLUMNS, scan_reading_documents, scan_units, write_layer
from skyfare.sources.zones import measure_zones


def _landed_units(partitions: DataFrame | None) -> DataFrame | None:
    """``taxi_type, year, month`` whose files are not all empty."""
    if partitions is None or not set(UNIT_COLUMNS) <= set(partitions.columns):
        return None
    return partitions.filter("bytes > 0").select(
        "taxi_type", F.col("year").try_cast("int").alias("year"), F.col("month").try_cast("int").alias("month")
    )


def missing_months(
    spark: SparkSession, destination: str, taxi_type: str, start: str, end: str
) -> DataFrame:
    """The planned months of a feed that ``destination`` does not hold yet."""
    plan = plan_months(bounds(spark, start, end)).withColumn("taxi_type", F.lit(taxi_type))
    landed = _landed_units(list_partitions(spark, destination))
    return plan if landed is None else plan.join(landed, list(UNIT_COLUMNS), "left_anti")


def land_missing_months(
    spark: SparkSession, landing: str, destination: str, taxi_type: str, start: str, end: str
) -> list[tuple[int, int]]:
    """Copy the months that are planned but not landed; return them in order.

    A month without files or without rows in ``landing`` stops the run before
    anything is written. Months keep their own file schema. The zones of the new
    files are measured, see ``zones``.
    """
    missing = missing_months(spark, destination, taxi_type, start, end)
    # at most one row per month of the plan
    wanted = sorted((r.year, r.month) for r in missing.collect())
    if not wanted:
        return []
    files = list_files(spark, landing)
    if files is None or not set(UNIT_COLUMNS) <= set(files.columns):
        raise FileNotFoundError(f"no trip files under {landing}")
    unit = F.struct(F.col("year").try_cast("int"), F.col("month").try_cast("int"))
    chosen = (F.col("taxi_type") == taxi_type) & _among(unit, wanted)
    frames = scan_units(spark, landing, files.filter(chosen & (F.col("length") > 0)))
    _require_rows(frames, taxi_type, wanted)
    for frame in frames:
        write_layer(frame, destination, UNIT_COLUMNS, replace="partitions", cluster=False)
    measure_zones(spark, destination)
    return wanted


def _among(unit: Column, months: list[tuple[int, int]]) -> Column:
    return unit.isin(*[F.struct(F.lit(year), F.lit(month)) for year, month in months])


def _require_rows(frames: list[DataFrame], taxi_type: str, wanted: list[tuple[int, int]]) -> None:
    # grouping by partition columns alone reads footers, not rows
    counts = [f.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows")) for f in frames]
    found = (
        {(int(r.year), int(r.month)) for r in reduce(DataFrame.unionByName, counts).collect()}
        if counts
        else set()
    )
    empty = [f"{taxi_type} {year}-{month:02d}" for year, month in wanted if (year, month) not in found]
    if empty:
        raise RuntimeError("no rows to land for " + ", ".join(empty))


def tag_provenance(documents: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Add the day a document was fetched for and where it came from.

    Without ``endpoint`` the origin is the file the document was read from.
    """
    origin = F.col("_metadata.file_path") if endpoint is None else F.lit(endpoint)
    return documents.select(
        *documents.columns,
        F.struct(F.col("date").alias("fetched_for_date"), origin.alias("endpoint")).alias("provenance"),
    )


def landed_days(spark: SparkSession, destination: str) -> DataFrame | None:
    """The days ``destination`` holds, from its directory names; names that are no day don't count."""
    partitions = list_partitions(spark, destination)
    if partitions is None or "date" not in partitions.columns:
        return None
    days = partitions.filter("bytes > 0").select(F.col("date").try_cast("date").alias("date"))
    return days.filter("date is not null")


def land_new_days(
    spark: SparkSession,
    landing: str,
    destination: str,
    start: str,
    end: str,
    today: str,
    fill_gaps: bool = False,
) -> list[str]:
    """Land the window's unseen days of documents; return them in order.

    Unseen means after the last landed day or, with ``fill_gaps``, not landed
    at all. A planned day without a document stops the run before anything is
    written, so the high-water mark never passes over it.
    """
    plan = plan_gaps if fill_gaps else plan_incremental
    days = plan(bounds(spark, start, end), landed_days(spark, destination), today)
    # at most one row per day of the plan
    wanted = sorted(r.date for r in days.collect())
    if not wanted:
        return []
    documents = scan_reading_documents(spark, landing).filter(F.col("date").isin(wanted))
    found = {r.date for r in documents.select("date").distinct().collect()}
    absent = [day.isoformat() for day in wanted if day not in found]
    if absent:
        raise FileNotFoundError("no reading document for " + ", ".join(absent))
    write_layer(tag_provenance(documents), destination, ["date"], replace="partitions", cluster=False)
    return [day.isoformat() for day in wanted]
