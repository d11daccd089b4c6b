"""Counts and ranges of a stored table from its Parquet footers, not from its rows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfare.sources.files import list_partitions

PROFILE = "column string, rows bigint, filled bigint, lowest string, highest string"

# Types whose smallest and largest value Spark takes from footers, and types of one value.
RANGED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# What Spark says of a file whose footer has no range: there is a NaN in it, or nothing but NULLs.
NO_RANGE = "No min/max found"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose Parquet scans answer aggregates from footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def _shown(value: Column, field: T.StructField) -> Column:
    # a footer may say -0.0 for 0.0
    number = value + F.lit(0.0).cast(field.dataType) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else value
    return number.cast("string")


def _ranges(fields: list[T.StructField]) -> list[Column]:
    found = []
    for k, field in enumerate(fields):
        column = F.col(f"`{field.name.replace('`', '``')}`")
        found += [_shown(F.min(column), field).alias(f"lowest_{k}"), _shown(F.max(column), field).alias(f"highest_{k}")]
    return found


def _counts(fields: list[T.StructField]) -> list[Column]:
    names = [f"`{field.name.replace('`', '``')}`" for field in fields]
    return [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(n)).alias(f"filled_{k}") for k, n in enumerate(names)]]


def by_footers(table: DataFrame, fields: list[T.StructField], ranges: bool) -> DataFrame:
    """One row of counts, and ranges if wanted, of columns that are no partition columns."""
    return table.agg(*_counts(fields), *(_ranges(fields) if ranges else []))


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per column of a Parquet table: ``column, rows, filled, lowest, highest``.

    ``filled`` counts values that are not NULL. The range is text, NULL without a
    value and for nested types; NaN is the largest number. Counts and the ranges
    of numbers, dates and truth values come from footers, so the work grows with
    the files and not with the rows; partition columns come from the counts of
    their directories. Times and texts have no exact range there, nested columns
    no count: those columns alone are read. Where a file's footer lacks a range (it
    holds a NaN, or NULLs only), the ranges of such types are read as well.
    """
    stored = footer_session(spark).read.parquet(path)
    plain = spark.read.parquet(path)
    levels = _partition_columns(spark, path, plain)
    fields = [f for f in plain.schema if f.name not in levels]
    flat = [f for f in fields if not isinstance(f.dataType, NESTED)]
    nested = [f for f in fields if isinstance(f.dataType, NESTED)]
    ranged = [f for f in flat if isinstance(f.dataType, RANGED)]
    other = [f for f in flat if not isinstance(f.dataType, RANGED)]

    counts = by_footers(stored, flat, ranges=False).first()
    # pushed counts of no file at all are NULL
    found = {f.name: [counts["rows"] or 0, counts[f"filled_{k}"] or 0, None, None] for k, f in enumerate(flat)}
    if ranged:
        _put(found, ranged, _ranged_row(stored, plain, ranged))
    if other:
        _put(found, other, plain.agg(*_ranges(other)).first())
    if nested:
        row = plain.agg(*_counts(nested)).first()
        found |= {f.name: [row["rows"], row[f"filled_{k}"], None, None] for k, f in enumerate(nested)}
    if levels:
        # a row per directory, from footers; their columns are then a small table
        per_directory = stored.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
        for name in levels:
            value = F.col(name)
            row = per_directory.agg(
                F.coalesce(F.sum("n"), F.lit(0)),
                F.coalesce(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0)),
                F.min(value).cast("string"),
                F.max(value).cast("string"),
            ).first()
            found[name] = list(row)
    rows = [(f.name, *found[f.name]) for f in plain.schema]
    return spark.createDataFrame(rows, PROFILE)


def _put(found: dict[str, list], fields: list[T.StructField], row: T.Row) -> None:
    for k, field in enumerate(fields):
        found[field.name][2:] = [row[f"lowest_{k}"], row[f"highest_{k}"]]


def _ranged_row(stored: DataFrame, plain: DataFrame, fields: list[T.StructField]) -> T.Row:
    try:
        return stored.agg(*_ranges(fields)).first()
    except (Py4JJavaError, PySparkException) as error:
        if NO_RANGE not in str(error):
            raise
    return plain.agg(*_ranges(fields)).first()


def _partition_columns(spark: SparkSession, path: str, table: DataFrame) -> list[str]:
    """The table's columns that are directories, outermost first."""
    listed = list_partitions(spark, path)
    return [] if listed is None else [name for name in listed.columns[3:] if name in table.columns]
