"""Scans and sinks of the pipeline's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Literal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.schemas import READING_DOCUMENT
from skyfare.sources.files import list_files, list_partitions
from skyfare.sources.footers import schema_groups

# Partition columns of the landed monthly trip files.
UNIT_COLUMNS = ("taxi_type", "year", "month")

# Rows of one written file at most, some gigabytes of trips.
MOST_RECORDS = 20_000_000


def scan_raw_trips(
    spark: SparkSession,
    root: str,
    taxi_types: Iterable[str] | None = None,
    first_month: str | None = None,
    last_month: str | None = None,
) -> list[DataFrame]:
    """Raw trips below ``taxi_type=/year=/month=``, one frame per file schema.

    Only directories of the wanted feeds and months (``yyyy-MM``, inclusive)
    are read. Monthly files drift in column types, which a single scan cannot
    bridge, so the months are grouped by their Parquet schema: a handful of
    scans, however many months there are. Each frame has ``taxi_type``,
    ``year`` and ``month`` columns. Raises FileNotFoundError if nothing is left.
    """
    files = list_files(spark, root)
    if files is None or not set(UNIT_COLUMNS) <= set(files.columns):
        raise FileNotFoundError(f"no trip files under {root}")
    month = F.concat_ws("-", F.lpad("year", 4, "0"), F.lpad("month", 2, "0"))
    wanted = F.col("length") > 0
    if taxi_types is not None:
        wanted &= F.col("taxi_type").isin(list(taxi_types))
    if first_month is not None:
        wanted &= month >= first_month
    if last_month is not None:
        wanted &= month <= last_month
    frames = scan_units(spark, root, files.filter(wanted))
    if not frames:
        raise FileNotFoundError(f"no trip files for the wanted feeds and months under {root}")
    return frames


def scan_units(spark: SparkSession, root: str, files: DataFrame, by_file: bool = False) -> list[DataFrame]:
    """One scan per distinct Parquet schema over the directories of ``files`` (directory, path).

    With ``by_file`` only these files are opened, and not all others of their directories.
    """
    return [scan_files(spark, root, *group) for group in schema_groups(spark, files, by_file)]


def scan_files(spark: SparkSession, root: str, schema: T.StructType, paths: list[str]) -> DataFrame:
    """Files or directories of one schema, with the columns of their place below ``root``."""
    units = T.StructType([T.StructField(name, T.StringType()) for name in UNIT_COLUMNS])
    return spark.read.schema(T.StructType([*schema, *units])).option("basePath", root).parquet(*paths)


def scan_reading_documents(spark: SparkSession, root: str) -> DataFrame:
    """Daily JSON documents below ``date=``, one row per document.

    A document may span lines. One that is not JSON at all stops the job, as
    skipping it would silently lose a day. Raises FileNotFoundError if there is
    no document.
    """
    try:
        return (
            spark.read.schema(READING_DOCUMENT)
            .option("multiLine", True)
            .option("mode", "FAILFAST")
            .json(root)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no reading documents under {root}") from error
        raise


def scan_layer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by this library, under its declared schema."""
    return spark.read.schema(schema).parquet(path)


def scan_if_exists(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """A Parquet table, or None if its path is absent or holds no file."""
    try:
        return spark.read.parquet(path) if schema is None else scan_layer(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_layer(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    replace: Literal["table", "partitions"] = "table",
    cluster: bool = True,
    observed: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Write a partitioned Parquet table and return its path.

    ``replace="table"`` leaves nothing of an earlier table; ``"partitions"``
    replaces only the partitions that ``df`` has rows for (those it has none
    for are left to ``drop_emptied_partitions``). ``cluster`` gathers
    each partition's rows before the write so that files stay few. The
    rebalance hint lets adaptive execution split a partition that is far larger
    than the others over several tasks, and put small ones together. A frame
    that comes off a scan of an equally partitioned table needs no gathering.
    ``observed`` adds metrics to the rows as they are written, after the last
    shuffle, so that a task that runs again counts once.
    """
    if cluster:
        df = df.hint("rebalance", *partition_by)
    if observed is not None:
        df = observed(df)
    (
        df.write.mode("overwrite")
        .option("maxRecordsPerFile", MOST_RECORDS)
        .option("partitionOverwriteMode", "static" if replace == "table" else "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    return path


def drop_emptied_partitions(spark: SparkSession, path: str, kept: DataFrame, wanted: Column) -> list[str]:
    """Delete the wanted partitions of a table that ``kept`` does not name; returns their directories.

    ``kept`` has the table's partition columns. Replacing partitions leaves
    those alone that got no row, so one that lost all of its rows would keep
    the old ones. ``wanted`` is a condition on the partition values as text.
    What is listed grows with the calendar, not with the rows.
    """
    stored = list_partitions(spark, path)
    if stored is None or not set(kept.columns) <= set(stored.columns):
        return []
    named = kept.select(*[F.col(name).cast("string").alias(name) for name in kept.columns]).distinct()
    emptied = stored.filter(wanted).join(named, kept.columns, "left_anti")
    directories = [r.directory for r in emptied.orderBy("directory").collect()]
    for directory in directories:
        place = spark._jvm.org.apache.hadoop.fs.Path(directory)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    return directories
