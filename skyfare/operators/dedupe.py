"""Keeping one row per key, with a survivor that every run agrees on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in the order of the remaining columns, NULLs first.

    NULL keys equal each other. Spark applies the limit of one row per key on
    the map side too, so however many copies a key has, each map task sends one
    of them, and the survivor does not depend on task order or retries. A hash
    of the key leads the sort: it settles nearly every comparison, where the
    first key column alone would tie most of the time.
    """
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.distinct()
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    of_key = Window.partitionBy("_hash", *keys).orderBy(*rest)
    ranked = hashed.withColumn("_rank", F.row_number().over(of_key))
    return ranked.filter(F.col("_rank") == 1).select(*df.columns)
