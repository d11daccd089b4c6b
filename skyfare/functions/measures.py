"""Scalar expressions of the daily metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: trips shorter than this count as this long.
SHORTEST_DISTANCE = 0.1


def price_per_distance(amount: Column, distance: Column) -> Column:
    """Amount per unit of distance; a NULL distance counts as the shortest."""
    return amount / F.greatest(distance, F.lit(SHORTEST_DISTANCE))


def mean(total: Column, counted: Column) -> Column:
    """Mean from a sum and the number of values in it; NULL if there are none."""
    return F.try_divide(total, counted)


def no_payment_counts() -> Column:
    """The payment map of a feed without payment types."""
    return F.lit(None).cast("map<string,bigint>")
