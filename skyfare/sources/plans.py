"""What to ingest next: months, days and file names as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name of a monthly trip file and its directory in the table.
FILE_NAME = "%s_tripdata_%04d-%02d.parquet"
DIRECTORY = "taxi_type=%s/year=%04d/month=%02d"


def bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row with the dates ``start`` and ``end``; a month stands for its first day."""
    first_of = [f"{text}-01" if len(text) == 7 else text for text in (start, end)]
    return spark.range(1).select(
        F.lit(first_of[0]).cast("date").alias("start"), F.lit(first_of[1]).cast("date").alias("end")
    )


def plan_months(window: DataFrame) -> DataFrame:
    """``year`` and ``month`` from ``start`` to ``end``, both included.

    A window that ends before it starts is an error.
    """
    first, last = F.trunc("start", "month"), F.trunc("end", "month")
    message = F.format_string(
        "start month %s is after end month %s", F.date_format(first, "yyyy-MM"), F.date_format(last, "yyyy-MM")
    )
    months = F.when(first > last, F.raise_error(message)).otherwise(
        F.sequence(first, F.greatest(first, last), F.expr("interval 1 month"))
    )
    return window.select(F.explode(months).alias("first_day")).select(
        F.year("first_day").alias("year"), F.month("first_day").alias("month")
    )


def plan_days(window: DataFrame) -> DataFrame:
    """Each ``date`` from ``start`` to ``end``; none if the window is reversed."""
    days = F.sequence("start", F.greatest("start", "end"), F.expr("interval 1 day"))
    return window.filter("start <= end").select(F.explode(days).alias("date"))


def plan_incremental(window: DataFrame, landed: DataFrame | None, today: str) -> DataFrame:
    """The days still to fetch, by high-water mark.

    From the day after the last landed ``date`` (or the window's start) up to
    the window's end or ``today``. A gap below the last landed day is not seen
    here; ``plan_gaps`` finds those.
    """
    ends = window.select(
        "start",
        F.least("end", F.lit(today).cast("date")).alias("end"),
        F.lit(None).cast("date").alias("next"),
    )
    if landed is not None:
        none = F.lit(None).cast("date")
        marks = landed.select(none.alias("start"), none.alias("end"), F.date_add("date", 1).alias("next"))
        ends = ends.unionByName(marks)
    # one row; greatest skips the NULL mark of an empty table
    ends = ends.agg(
        F.greatest(F.max("start"), F.max("next")).alias("start"), F.max("end").alias("end")
    )
    return plan_days(ends)


def plan_gaps(window: DataFrame, landed: DataFrame | None, today: str) -> DataFrame:
    """Every day of the window up to ``today`` that has not landed."""
    days = plan_incremental(window, None, today)
    return days if landed is None else days.join(landed.select("date"), "date", "left_anti")


def plan_manifest(
    months: DataFrame, taxi_type: str, source_pattern: str, destination: str
) -> DataFrame:
    """Where each planned month comes from and where it goes, zero-padded.

    ``source_pattern`` is a printf pattern over taxi type, year and month.
    """
    unit = (F.lit(taxi_type), F.col("year"), F.col("month"))
    target = F.concat_ws(
        "/", F.lit(destination), F.format_string(DIRECTORY, *unit), F.format_string(FILE_NAME, *unit)
    )
    return months.select(
        F.lit(taxi_type).alias("taxi_type"),
        "year",
        "month",
        F.format_string(source_pattern, *unit).alias("source"),
        target.alias("destination"),
    )
