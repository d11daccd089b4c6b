"""Zone map of raw trip files: the smallest and largest pickup time of each, kept beside them.

A monthly file also holds trips of other days, so its name does not tell which
days it can stand for; its zone does. An incremental run opens only files whose
zone meets its window. A file is known by path, length and modification time:
one that was replaced since, or never measured, has no zone and is always read.
"""

from __future__ import annotations

from collections.abc import Collection
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.functions.parsing import tolerant_cast
from skyfare.operators.conform import pick_name
from skyfare.schemas import TRIP_FIELDS
from skyfare.sources.files import list_files
from skyfare.sources.footers import schema_groups
from skyfare.sources.tables import scan_if_exists, scan_files

ZONES = "_zones"
FILE = ("path", "length", "modified")


def zone_map(spark: SparkSession, root: str) -> DataFrame | None:
    """``path, length, modified, first_pickup, last_pickup, rows`` of measured files; None before the first."""
    return scan_if_exists(spark, f"{root.rstrip('/')}/{ZONES}")


def pickup_time(frame: DataFrame) -> Column:
    """The pickup time of raw trips, under whatever name and type; NULLs without that column."""
    field = next(f for f in TRIP_FIELDS if f.name == "pickup_datetime")
    name = pick_name(frame.columns, field.raw_names)
    if name is None:
        return F.lit(None).cast(field.type)
    return tolerant_cast(F.col(name), frame.schema[name].dataType, field.type)


def _zone_of(frame: DataFrame) -> DataFrame:
    pickup = pickup_time(frame)
    # the name as a listing has it, without the escapes of an address
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return frame.groupBy(path.alias("path")).agg(
        F.min(pickup).alias("first_pickup"), F.max(pickup).alias("last_pickup"), F.count(F.lit(1)).alias("rows")
    )


def measure_zones(spark: SparkSession, root: str) -> int:
    """Measure the raw files that have no zone yet and append theirs; returns how many those were.

    Reads one column of new files and nothing of the others. Running it again,
    or after a run that was cut short, measures what is left.
    """
    files = list_files(spark, root)
    if files is None:
        return 0
    files = files.filter("length > 0")
    known = zone_map(spark, root)
    if known is not None:
        files = files.join(known.select(*FILE), list(FILE), "left_anti")
    # held in memory: the table they are compared with is the one that is written to
    new = spark.createDataFrame(files.toArrow())
    number = new.count()
    if not number:
        return 0
    groups = schema_groups(spark, new, by_file=True)
    found = reduce(DataFrame.unionByName, [_zone_of(scan_files(spark, root, schema, paths)) for schema, paths in groups])
    # a file without rows yields no group, but has a zone: none
    zones = new.select(*FILE).join(found, "path", "left")
    zones.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/{ZONES}")
    return number


def files_of_window(
    spark: SparkSession,
    root: str,
    first_day: str | None,
    last_day: str | None,
    days: Collection[str] | None = None,
) -> DataFrame | None:
    """``directory, path`` of the raw files that may hold trips of an inclusive window; None without files.

    ``days`` narrows the window to single days.
    """
    files = list_files(spark, root)
    if files is None:
        return None
    files = files.filter("length > 0")
    known = zone_map(spark, root)
    if known is None:
        return files
    outside = F.col("first_pickup").isNull()
    if first_day is not None:
        outside |= F.col("last_pickup") < F.lit(first_day).cast("timestamp_ntz")
    if last_day is not None:
        outside |= F.col("first_pickup") >= F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz")
    if days is not None:
        single = F.lit([date.fromisoformat(day) for day in days]) if days else F.array().cast("array<date>")
        met = F.exists(single, lambda day: day.between(F.to_date("first_pickup"), F.to_date("last_pickup")))
        outside |= ~met
    return files.join(known.filter(outside).select(*FILE), list(FILE), "left_anti")
