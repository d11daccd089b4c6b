"""From raw trips of any feed to one clean trip table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfare.functions.parsing import tolerant_cast
from skyfare.operators.dedupe import keep_one
from skyfare.schemas import REQUIRED_TRIP_FIELDS, TRIP_FIELDS, TRIP_KEY, TripField


def pick_name(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that exists, whatever its letter case.

    The choice is made on names alone: an existing column full of NULLs wins
    over a later candidate that has values.
    """
    by_lower = {name.lower(): name for name in columns}
    found = (by_lower[c.lower()] for c in candidates if c.lower() in by_lower)
    return next(found, None)


def pick_column(df: DataFrame, *candidates: str) -> Column:
    """The column ``pick_name`` finds, or a NULL literal."""
    name = pick_name(df.columns, candidates)
    return F.lit(None) if name is None else F.col(name)


def missing_required(df: DataFrame) -> list[str]:
    """Conformed names without which no row of ``df`` would survive cleaning."""
    return [
        f.name
        for f in TRIP_FIELDS
        if f.name in REQUIRED_TRIP_FIELDS and pick_name(df.columns, f.raw_names) is None
    ]


def conform_trips(df: DataFrame, taxi_type: str | Column) -> DataFrame:
    """Rename and cast a raw feed to the ten trip columns plus ``taxi_type``."""

    def conformed(field: TripField) -> Column:
        name = pick_name(df.columns, field.raw_names)
        if name is None:
            return F.lit(None).cast(field.type).alias(field.name)
        return tolerant_cast(F.col(name), df.schema[name].dataType, field.type).alias(field.name)

    tag = F.lit(taxi_type) if isinstance(taxi_type, str) else taxi_type
    return df.select(*map(conformed, TRIP_FIELDS), tag.alias("taxi_type"))


def with_valid_times(df: DataFrame) -> DataFrame:
    """Both times present, and the trip does not end before it starts."""
    return df.filter(
        F.col("pickup_datetime").isNotNull()
        & F.col("dropoff_datetime").isNotNull()
        & (F.col("dropoff_datetime") >= F.col("pickup_datetime"))
    )


def with_valid_measures(df: DataFrame) -> DataFrame:
    """Distance and fare at least zero; a NULL in either drops the row."""
    return df.filter((F.col("trip_distance") >= 0) & (F.col("fare_amount") >= 0))


def dedupe_trips(df: DataFrame) -> DataFrame:
    """One row per trip key and feed.

    The feed is part of the grouping key, so one pass over all feeds gives what
    deduplicating feed by feed would, with a single shuffle.
    """
    return keep_one(df, [*TRIP_KEY, "taxi_type"])


def with_pickup_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"pickup_date": F.to_date("pickup_datetime"), "pickup_hour": F.hour("pickup_datetime")}
    )


def clean_conformed(df: DataFrame) -> DataFrame:
    """Filters, deduplication and calendar columns on conformed trips."""
    return (
        df.transform(with_valid_times)
        .transform(with_valid_measures)
        .transform(dedupe_trips)
        .transform(with_pickup_calendar)
    )


def clean_trips(df: DataFrame, taxi_type: str | Column) -> DataFrame:
    """Conform and clean one raw feed."""
    return conform_trips(df, taxi_type).transform(clean_conformed)


def conform_feeds(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Raw feeds by taxi type as one conformed table."""
    return union_feeds([conform_trips(df, taxi_type) for taxi_type, df in feeds.items()])


def union_feeds(frames: Sequence[DataFrame]) -> DataFrame:
    """All feeds as one table; a column that a feed lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
