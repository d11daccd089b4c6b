"""Daily metrics of enriched trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyfare.functions.measures import mean, no_payment_counts, price_per_distance
from skyfare.operators.dedupe import keep_one

DAY = "pickup_date"
HOUR = "pickup_hour"


def _measures() -> dict[str, Column]:
    """The averaged quantities, by the name of the average."""
    return {
        "avg_fare_amount": F.col("fare_amount"),
        "avg_total_amount": F.col("total_amount"),
        "avg_trip_distance": F.col("trip_distance"),
        "surge_proxy": price_per_distance(F.col("total_amount"), F.col("trip_distance")),
    }


def daily_trip_metrics(trips: DataFrame) -> DataFrame:
    """Trip count and averages per day; averages skip NULLs."""
    averages = [F.avg(value).alias(name) for name, value in _measures().items()]
    return trips.groupBy(DAY).agg(F.count(F.lit(1)).alias("total_trips"), *averages)


def payment_counts(trips: DataFrame) -> DataFrame:
    """Trips per day and payment type; trips without a type are left out."""
    return (
        trips.select(DAY, F.col("payment_type").cast("string").alias("payment_type_key"))
        .filter(F.col("payment_type_key").isNotNull())
        .groupBy(DAY, "payment_type_key")
        .count()
    )


def payment_map(counts: DataFrame) -> DataFrame:
    """Payment counts as one map per day, entries in key order."""
    return counts.groupBy(DAY).agg(
        _as_map(F.col("payment_type_key"), F.col("count")).alias("payment_type_counts")
    )


def _as_map(key: Column, count: Column) -> Column:
    # one entry per payment type of the day: the size of the map itself
    entry = F.when(key.isNotNull(), F.struct(key.alias("key"), count.alias("value")))
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


def daily_readings(trips: DataFrame) -> DataFrame:
    """Mean temperature and total rain over the day's hours that have a trip.

    ``distinct`` hashes the trips down to about one row per hour first, so only
    those few are sorted to pick one reading per hour.
    """
    seen = trips.select(DAY, HOUR, "temperature_2m", "precipitation").distinct()
    hours = keep_one(seen, [DAY, HOUR])
    return hours.groupBy(DAY).agg(
        F.avg("temperature_2m").alias("avg_temp"),
        F.sum(F.coalesce("precipitation", F.lit(0.0))).alias("total_precip"),
    )


def daily_metrics(enriched: DataFrame) -> DataFrame:
    """Trip metrics, weather and payment mix per day, from one scan of the trips.

    The trips are rolled up once to (day, hour, payment type, reading), a few
    rows per hour, with partial aggregation before the only shuffle that grows
    with the data. Weather is a grouping key there because it belongs to the
    hour: it adds no groups, and the roll-up stays a hash aggregate. The few
    rows of a day then move together once, and all else happens in place.
    """
    has_payment = "payment_type" in enriched.columns
    payment = F.col("payment_type") if has_payment else F.lit(None).cast("int")
    measures = _measures()
    sums = [F.sum(value).alias(f"{name}_sum") for name, value in measures.items()]
    sizes = [F.count(value).alias(f"{name}_n") for name, value in measures.items()]
    hourly = (
        enriched.withColumn("_payment", payment)
        .groupBy(DAY, HOUR, "_payment", "temperature_2m", "precipitation")
        .agg(F.count(F.lit(1)).alias("trips"), *sums, *sizes)
    )

    totals = ["trips", *[f"{name}_{part}" for name in measures for part in ("sum", "n")]]
    add_up = [F.sum(name).alias(name) for name in totals]
    typed = hourly.groupBy(DAY, HOUR, F.col("_payment").cast("string").alias("key")).agg(
        F.min(F.struct("temperature_2m", "precipitation")).alias("reading"), *add_up
    )

    # From here a day has at most one row per hour and payment type, so even
    # the busiest day fits one task and needs no further shuffle.
    typed = typed.repartition(DAY)

    # exactly one row of each hour carries the hour's reading
    in_hour = Window.partitionBy(DAY, HOUR).orderBy("reading", "key")
    carries = F.row_number().over(in_hour) == 1
    marked = typed.withColumn("carried", F.when(carries, F.col("reading")))
    per_payment = marked.groupBy(DAY, "key").agg(
        F.sum("carried.temperature_2m").alias("temp_sum"),
        F.count("carried.temperature_2m").alias("temp_n"),
        F.sum(F.when(F.col("carried").isNotNull(), F.coalesce("carried.precipitation", F.lit(0.0)))).alias("rain"),
        *add_up,
    )

    days = per_payment.groupBy(DAY).agg(
        F.sum("temp_sum").alias("temp_sum"),
        F.sum("temp_n").alias("temp_n"),
        F.sum("rain").alias("rain"),
        _as_map(F.col("key"), F.col("trips")).alias("payments"),
        *add_up,
    )
    # trips without a date form a group, but no weather or payments join to it
    dated = F.col(DAY).isNotNull()
    payments = F.when(dated & (F.size("payments") > 0), F.col("payments"))
    return days.select(
        F.col(DAY).alias("date"),
        F.col("trips").alias("total_trips"),
        *[mean(F.col(f"{name}_sum"), F.col(f"{name}_n")).alias(name) for name in measures],
        F.when(dated, mean(F.col("temp_sum"), F.col("temp_n"))).alias("avg_temp"),
        F.when(dated, F.col("rain")).alias("total_precip"),
        (payments if has_payment else no_payment_counts()).alias("payment_type_counts"),
    )
