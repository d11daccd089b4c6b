"""Expressions over the parallel arrays of a reading document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_or_null(values: Column, index: Column) -> Column:
    """``values[index]``, or NULL for a NULL array or an index past its end."""
    return F.get(values, index)


def first_filled(preferred: Column, fallback: Column) -> Column:
    """``preferred`` unless it is NULL or empty, else ``fallback``."""
    return F.when(F.size(preferred) > 0, preferred).otherwise(fallback)
