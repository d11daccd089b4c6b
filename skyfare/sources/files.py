"""What is stored under a path, from file listings alone: no file is opened."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns a binaryFile scan has besides the partition columns.
_FILE_COLUMNS = ("path", "modificationTime", "length", "content")


def list_partitions(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per partition directory: ``directory``, ``files``, ``bytes`` and its values.

    None if the path does not exist. The values are text, so a month ``01`` keeps
    its zero, without the escapes that special characters have in a path. The listing is taken at once and
    held as a small table: its length is that of the calendar, not of the data.
    """
    listed = _per_directory(spark, root)
    return None if listed is None else spark.createDataFrame(sorted(listed.collect()), listed.schema)


def table_bytes(spark: SparkSession, root: str) -> int:
    """Total size of a table's files; 0 if there are none."""
    listed = _per_directory(spark, root)
    return 0 if listed is None else listed.agg(F.sum("bytes").alias("bytes")).first().bytes or 0


def list_files(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per file: ``directory, path, length, modified`` and the partition values; None without the path.

    ``modified`` counts microseconds. Hidden files and folders, whose names start with a dot or an underscore,
    are left out. The listing is taken at once: it is what the driver holds to plan a scan of them.
    """
    files = _files(spark, root)
    if files is None:
        return None
    levels = [name for name in files.columns if name not in _FILE_COLUMNS]
    directory = F.regexp_replace("path", "/[^/]*$", "").alias("directory")
    listed = files.select(directory, "path", "length", F.unix_micros("modificationTime").alias("modified"))
    listed = listed.select("*", *[_unescaped(_segment(f"{name}=([^/]*)")).alias(name) for name in levels])
    return spark.createDataFrame(listed.toArrow())


def _per_directory(spark: SparkSession, root: str) -> DataFrame | None:
    files = _files(spark, root)
    if files is None:
        return None
    levels = [name for name in files.columns if name not in _FILE_COLUMNS]
    return (
        files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        .select(
            "*",
            *[_unescaped(_segment(f"{name}=([^/]*)")).alias(name) for name in levels],
        )
    )


def _files(spark: SparkSession, root: str) -> DataFrame | None:
    # Contents are not read, so splits need not be small: without this a large
    # table would be listed by as many tasks as it takes to scan it. The setting
    # is that of a session of its own, so other queries never see it.
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1t")
    try:
        return own.read.format("binaryFile").load(root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _segment(pattern: str) -> Column:
    return F.regexp_extract("directory", f"/{pattern}(/|$)", 1)


def _unescaped(value: Column) -> Column:
    """``%3A`` and the like as characters; a plus sign stays one."""
    plain = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.coalesce(plain, value)


def partition_values(spark: SparkSession, root: str, column: str) -> DataFrame:
    """The sorted distinct values of one partition column; empty without a table."""
    partitions = list_partitions(spark, root)
    if partitions is None or column not in partitions.columns:
        return spark.createDataFrame([], f"{column} string")
    return partitions.select(column).distinct().orderBy(column)


def partition_inventory(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` top-level partition names, with files and bytes of each."""
    partitions = list_partitions(spark, root)
    levels = [] if partitions is None else partitions.columns[3:]
    if not levels:
        return spark.createDataFrame([], "partition string, files bigint, bytes bigint")
    return (
        partitions.groupBy(_segment(f"({levels[0]}=[^/]*)").alias("partition"))
        .agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        .orderBy("partition")
        .limit(limit)
    )
