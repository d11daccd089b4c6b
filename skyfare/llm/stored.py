"""Intermediate tables in the shared folder, which lost executors can't take with them."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from skyfare.sources.scratch import scratch_path
from skyfare.sources.settings import setting

# Shuffle files of a write go once it is done: nobody runs that plan again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it back: lineage ends there.

    Whoever owns that folder empties it; a result may still read the table
    long after the call that wrote it. A table that nothing reads any more may
    be given to ``discard``.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove stored tables whose results have been stored in turn."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
