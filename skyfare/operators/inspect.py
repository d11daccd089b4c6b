"""A look at a table: its columns, its size, a few of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column with its type and the table's row count."""
    columns = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
            )
            for i, field in enumerate(df.schema, start=1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.inline(columns), "row_count")


def sample_rows(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """The first ``rows`` rows in a stated order, so that every run shows the same."""
    return df.orderBy(*order_by).limit(rows)
