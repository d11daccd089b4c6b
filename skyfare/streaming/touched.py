"""What newly landed files change, carried through all tables: only the days they touch are built anew."""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare import schemas
from skyfare.operators.readings import flatten_readings, normalize_readings
from skyfare.plans.jobs import Layout, build_daily, build_enriched, build_readings, build_trips
from skyfare.sources.footers import schema_groups
from skyfare.sources.tables import scan_files, scan_if_exists, scan_reading_documents, write_layer
from skyfare.sources.zones import measure_zones, pickup_time

DocumentFormat = Literal["parquet", "json"]

# What a stream of files tells of each; their contents are not read.
FILE = "path string, modificationTime timestamp, length bigint, content binary"
TRIPS, READINGS = "trips", "readings"


def stream_files(spark: SparkSession, root: str, kind: str, files_per_batch: int) -> DataFrame:
    """``kind, path`` of the files below ``root``, each once, as they are found there."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True)
    listed = files.option("maxFilesPerTrigger", files_per_batch).load(root)
    return listed.filter("length > 0").select(F.lit(kind).alias("kind"), "path")


def _documents(spark: SparkSession, layout: Layout, form: DocumentFormat, paths: list[str] | None = None) -> DataFrame:
    if form == "json":
        if paths is None:
            return scan_reading_documents(spark, layout.raw_readings)
        reader = spark.read.schema(schemas.READING_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST")
        return reader.option("basePath", layout.raw_readings).json(paths)
    reader = spark.read.schema(schemas.LANDED_DOCUMENT).option("basePath", layout.raw_readings)
    return reader.parquet(*([layout.raw_readings] if paths is None else paths))


def _distinct_days(frames: list[DataFrame]) -> list[str]:
    """The days in the one column of each frame, in order; as many as the calendar has at most."""
    if not frames:
        return []
    found = reduce(DataFrame.unionByName, [f.toDF("day").distinct() for f in frames]).distinct()
    return sorted(r.day.isoformat() for r in found.filter("day IS NOT NULL").collect())


def touched_days(
    spark: SparkSession, layout: Layout, files: DataFrame, raw_readings_format: DocumentFormat = "parquet"
) -> tuple[list[str], list[str]]:
    """Pickup days of the trip files and reading days of the documents among ``files`` (kind, path).

    Of trip files one column is read. A file's name does not tell its days:
    monthly files also hold trips of other months.
    """
    trips = files.filter(F.col("kind") == TRIPS)
    trips = trips.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "path")
    groups = schema_groups(spark, trips, by_file=True) if not trips.isEmpty() else []
    scans = [scan_files(spark, layout.raw_trips, schema, paths) for schema, paths in groups]
    pickup = _distinct_days([f.select(F.to_date(pickup_time(f))) for f in scans])
    paths = [r.path for r in files.filter(F.col("kind") == READINGS).orderBy("path").collect()]
    if not paths:
        return pickup, []
    readings = normalize_readings(flatten_readings(_documents(spark, layout, raw_readings_format, paths)))
    return pickup, _distinct_days([readings.select("date")])


def rebuild_days(
    spark: SparkSession,
    layout: Layout,
    pickup: list[str],
    read: list[str],
    raw_readings_format: DocumentFormat = "parquet",
) -> list[str]:
    """Build the days with new trips and those with new readings again, in all tables that hold them.

    A day is built from all of its raw rows, not only from the new ones, so
    building it once more changes nothing.
    """
    days = sorted({*pickup, *read})
    if read:
        documents = _documents(spark, layout, raw_readings_format)
        build_readings(spark, documents, layout.readings, "partitions", days=read)
    if pickup:
        measure_zones(spark, layout.raw_trips)
        build_trips(spark, layout.raw_trips, layout.trips, replace="partitions", days=pickup)
    if days and scan_if_exists(spark, layout.trips) is not None:
        if scan_if_exists(spark, layout.readings) is None:
            none = spark.createDataFrame([], schemas.READINGS)
            write_layer(none, layout.readings, schemas.READINGS_PARTITIONS, cluster=False)
        build_enriched(spark, layout.trips, layout.readings, layout.enriched, replace="partitions", days=days)
        build_daily(spark, layout.enriched, layout.daily, replace="partitions", days=days)
    return days


def rebuild_touched(
    spark: SparkSession,
    layout: Layout,
    checkpoint: str,
    raw_readings_format: DocumentFormat = "parquet",
    files_per_batch: int = 10_000,
) -> list[str]:
    """Carry all raw files not seen before through the tables, then stop; returns the days built again.

    Both raw folders must exist. The checkpoint knows which files were seen: a
    run without new ones builds nothing, and a batch that was cut short is done
    again with the same files. A file that is replaced under its own name or
    removed is not seen; build its window with ``run_pipeline``.
    """
    rebuilt: set[str] = set()

    def rebuild(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        # the names of a batch's files, which the stream's driver lists anyway
        files = own.createDataFrame(batch.toArrow())
        pickup, read = touched_days(own, layout, files, raw_readings_format)
        rebuilt.update(rebuild_days(own, layout, pickup, read, raw_readings_format))

    trips = stream_files(spark, layout.raw_trips, TRIPS, files_per_batch)
    documents = stream_files(spark, layout.raw_readings, READINGS, files_per_batch)
    query = (
        trips.unionByName(documents)
        .writeStream.foreachBatch(rebuild)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sorted(rebuilt)
