"""Tables laid out in buckets of a key, so that equal keys meet without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfare.sources.settings import setting


def write_buckets(
    df: DataFrame,
    name: str,
    path: str,
    partition_by: Sequence[str],
    bucket_by: Sequence[str],
    buckets: int,
    replace: Literal["table", "partitions"] = "table",
) -> DataFrame:
    """Write a partitioned table whose partitions are cut into buckets; returns its scan.

    ``name`` is its entry in the session's catalog, which holds the layout; the
    files lie below ``path``. Rows move once, to the task of their bucket, so a
    hot partition is spread over all of them and each bucket of a partition is
    one file. Choose ``buckets`` for files of some hundred megabytes in a usual
    partition. Rows with NULLs in ``bucket_by`` share a bucket if all are NULL.
    Columns of floating point can't be in ``bucket_by``: grouping makes one of
    0.0 and -0.0, buckets do not. ``replace="partitions"`` replaces only those
    that ``df`` has rows for, in a table that is there already.
    """
    floating = [n for n, kind in df.select(*bucket_by).dtypes if kind in ("float", "double")]
    if floating:
        raise ValueError(f"no buckets by floating point columns {floating}")
    spark: SparkSession = df.sparkSession
    dealt = df.repartition(buckets, *bucket_by)
    if replace == "partitions" and spark.catalog.tableExists(name):
        with setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            dealt.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    else:
        writer = dealt.write.format("parquet").mode("overwrite").option("path", path)
        writer.partitionBy(*partition_by).bucketBy(buckets, *bucket_by).saveAsTable(name)
    return spark.table(name)


def month_slices(days: DataFrame, day: str) -> list[Column]:
    """Conditions, one for each month that ``days`` has and one for rows without a day.

    ``days`` lists a table's partition values (text or dates), a row for each
    day or so; what comes to the driver grows with the calendar. Each condition
    is on the partition column alone, so a scan under it opens that month only.
    """
    month = F.date_format(F.col(day).try_cast("date"), "yyyy-MM")
    months = [row["month"] for row in days.select(month.alias("month")).distinct().orderBy("month").collect()]
    first = [F.lit(f"{m}-01").cast("date") for m in months if m is not None]
    spans = [(F.col(day) >= a) & (F.col(day) < F.add_months(a, 1)) for a in first]
    return [*spans, F.col(day).isNull()]
