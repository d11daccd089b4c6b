"""Casts that give NULL, not an error, on values that cannot be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The layouts a reading's time may have besides Spark's default.
READING_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")

# What Spark takes off both ends of a text before it reads a time.
_TRIMMED = r"[\x00-\x20\x7F]*"

# Text that states a date and maybe a time of day, but no zone.
_ZONELESS = rf"^{_TRIMMED}\d{{4}}(-\d{{1,2}}(-\d{{1,2}}([ T]\d{{1,2}}:\d{{1,2}}(:\d{{1,2}}(\.\d*)?)?)?)?)?{_TRIMMED}$"

# Text that starts with a year. Spark takes today's date for a time of day alone.
_DATED = rf"^{_TRIMMED}[+-]?\d{{4}}"


def tolerant_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast to ``target``; values that do not fit become NULL.

    Equal types stay untouched so that filters on them still reach the scan.
    """
    if source == target:
        return column
    if isinstance(target, T.TimestampNTZType):
        return wall_clock(column, source)
    if isinstance(target, T.IntegerType) and isinstance(source, T.StringType):
        # "12.0" is a whole number in text form
        return column.try_cast("decimal(38,10)").try_cast("int")
    return column.try_cast(target)


def wall_clock(column: Column, source: T.DataType, formats: tuple[str, ...] = ()) -> Column:
    """Read a timestamp as local wall-clock time.

    Text without a zone keeps the clock reading it states. Instants (zoned
    text, zoned timestamps, epoch seconds) show the clock of the session zone.
    Text without a date is NULL, whatever day it is read on.
    """
    if isinstance(source, T.TimestampNTZType):
        return column
    if isinstance(source, T.DateType):
        return column.cast("timestamp_ntz")
    instant = column.try_cast("timestamp").cast("timestamp_ntz")
    if not isinstance(source, T.StringType):
        return instant
    parsed = F.when(column.rlike(_ZONELESS), column.try_cast("timestamp_ntz")).otherwise(instant)
    parsed = F.when(column.rlike(_DATED), parsed)
    extra = [F.try_to_timestamp(column, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(parsed, *extra) if extra else parsed
