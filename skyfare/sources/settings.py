"""Session settings that hold for one block and are put back after it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import SparkSession

# Shuffled rows take about this many times the bytes of their Parquet files.
EXPANSION = 2

# A reduce task of this size sorts within an executor's memory and writes a
# Parquet file of a few hundred megabytes.
BYTES_PER_TASK = 512 * 1024**2

# Spark's own target for a reduce task, good for tables of some gigabytes.
SPARK_BYTES_PER_TASK = 64 * 1024**2

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TARGET = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """Shuffle settings for a job that shuffles ``input_bytes`` of Parquet.

    Adaptive execution merges partitions that turn out small but never adds
    any, so the number it starts from has to grow with the input. The size it
    aims at grows too, up to ``BYTES_PER_TASK``, while every core still gets a
    few tasks: it decides how far a hot day is split and how large the written
    files are. What the session sets itself stands if it is larger.
    """
    shuffled = input_bytes * EXPANSION
    needed = -(-shuffled // BYTES_PER_TASK)
    own = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(PARTITIONS, None) or 0)
    )
    target = min(shuffled // (4 * spark.sparkContext.defaultParallelism), BYTES_PER_TASK)
    with ExitStack() as held:
        held.enter_context(setting(spark, PARTITIONS, str(max(needed, own))))
        if target > SPARK_BYTES_PER_TASK and spark.conf.get(TARGET, None) is None:
            held.enter_context(setting(spark, TARGET, f"{target}b"))
        yield
