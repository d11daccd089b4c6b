"""The same results in SQL, written for DuckDB over the same tables."""

from __future__ import annotations

# --- inputs, as common table expressions

SHIPPED = """
shipped AS (
  SELECT l_suppkey AS vendor_id, o_orderdate AS pickup_datetime, l_shipdate AS dropoff_datetime,
         c_nationkey AS pu_location_id, s_nationkey AS do_location_id,
         CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS passenger_count, l_quantity AS trip_distance, c_acctbal AS fare_amount,
         l_extendedprice AS total_amount,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN left(o_orderpriority, 1) END AS payment_type,
         CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'R' THEN 'green' ELSE 'hired' END AS taxi_type
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

CONFORMED_SHIPPED = SHIPPED + """,
conformed AS (
  SELECT CAST(vendor_id AS INTEGER) AS vendor_id, pickup_datetime, dropoff_datetime,
         CAST(pu_location_id AS INTEGER) AS pu_location_id,
         CAST(do_location_id AS INTEGER) AS do_location_id,
         CAST(passenger_count AS DOUBLE) AS passenger_count, trip_distance, fare_amount, total_amount,
         CAST(payment_type AS INTEGER) AS payment_type, taxi_type
  FROM shipped
)"""

TRIP_COLUMNS = """vendor_id, CAST(pickup_datetime AS VARCHAR) AS pickup_datetime,
         CAST(dropoff_datetime AS VARCHAR) AS dropoff_datetime, pu_location_id, do_location_id,
         passenger_count, trip_distance, fare_amount, total_amount, payment_type, taxi_type"""

CALENDAR = """CAST(CAST(pickup_datetime AS DATE) AS VARCHAR) AS pickup_date,
         CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour"""

VALID = """pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL
    AND dropoff_datetime >= pickup_datetime AND trip_distance >= 0 AND fare_amount >= 0"""

KEEP_ONE = """QUALIFY row_number() OVER (
    PARTITION BY vendor_id, pickup_datetime, dropoff_datetime, pu_location_id, do_location_id,
                 total_amount, taxi_type
    ORDER BY passenger_count NULLS FIRST, trip_distance NULLS FIRST, fare_amount NULLS FIRST,
             payment_type NULLS FIRST) = 1"""

RIDES = """
rides AS (
  SELECT CAST(user_id AS INTEGER) AS vendor_id, ts AS pickup_datetime,
         ts + to_minutes(k - 10) AS dropoff_datetime, k AS pu_location_id, 99 - k AS do_location_id,
         CASE WHEN event_type <> 'purchase' THEN CAST(k + copy AS DOUBLE) END AS passenger_count,
         k / 4.0 AS trip_distance, value * CAST(0.8 AS DOUBLE) - 1 AS fare_amount,
         value AS total_amount,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 END AS payment_type,
         CASE WHEN event_type IN ('click', 'view') THEN 'yellow'
              WHEN event_type = 'purchase' THEN 'green' ELSE 'hired' END AS taxi_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               unnest([0, 1]) AS copy FROM events)
)"""

CLEAN_RIDES = RIDES + f""",
clean AS (
  SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date,
         CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour
  FROM rides WHERE {VALID} {KEEP_ONE}
)"""

READINGS = """
readings AS (
  SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
         round(avg(value) + 1.37e-7, 4) AS temperature_2m, round(sum(value), 2) AS precipitation,
         CAST(count(value) AS DOUBLE) AS windspeed_10m
  FROM events WHERE event_type = 'signup' GROUP BY ALL
)"""

# The readings as the nested documents hold them: Mondays keep the first twelve
# temperatures of the day.
DOCUMENTS = READINGS + """,
listed AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY hour) AS place,
         dayofweek(date) IN (0, 6) AS weekend, dayofweek(date) = 1 AS monday
  FROM readings
),
flat AS (
  SELECT date, hour, place, weekend, monday,
         CASE WHEN NOT monday OR place <= 12 THEN temperature_2m END AS temperature_2m,
         precipitation, windspeed_10m
  FROM listed
)"""

TRIPS = """
trips AS (
  SELECT event_id, CAST(ts AS DATE) AS pickup_date, CAST(hour(ts) AS INTEGER) AS pickup_hour,
         value * CAST(0.8 AS DOUBLE) AS fare_amount, value AS total_amount,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS trip_distance,
         event_type AS payment_type
  FROM events
)"""

ENRICHED = TRIPS + "," + READINGS + """,
enriched AS (
  SELECT trips.*, temperature_2m, precipitation, windspeed_10m
  FROM trips LEFT JOIN readings ON pickup_date = date AND pickup_hour = hour
)"""

ENRICHED_RIDES = CLEAN_RIDES + "," + DOCUMENTS + """,
enriched AS (
  SELECT clean.*, temperature_2m, precipitation, windspeed_10m
  FROM clean LEFT JOIN flat ON pickup_date = date AND pickup_hour = hour
)"""

UNMATCHED = CONFORMED_SHIPPED + "," + READINGS + f""",
clean AS (
  SELECT *, CAST(pickup_datetime AS DATE) AS pickup_date, CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour
  FROM conformed WHERE {VALID} {KEEP_ONE}
),
enriched AS (
  SELECT clean.* REPLACE (CASE WHEN dayofweek(pickup_date) <> 0 THEN payment_type END AS payment_type),
         temperature_2m, precipitation
  FROM clean LEFT JOIN readings ON pickup_date = date AND pickup_hour = hour
)"""

RATIO = "total_amount / greatest(coalesce(trip_distance, 0.1), 0.1)"


def _daily(ctes: str, where: str = "TRUE", payments: bool = True) -> str:
    """The daily table over an ``enriched`` relation."""
    counted = f"""
payments AS (
  SELECT pickup_date, string_agg(payment_type || '=' || n, ',' ORDER BY payment_type) AS payment_type_counts
  FROM (SELECT pickup_date, CAST(payment_type AS VARCHAR) AS payment_type, count(*) AS n
        FROM enriched WHERE payment_type IS NOT NULL AND {where} GROUP BY ALL)
  GROUP BY pickup_date
)"""
    absent = "payments AS (SELECT CAST(NULL AS DATE) AS pickup_date, CAST(NULL AS VARCHAR) AS payment_type_counts)"
    return f"""WITH {ctes},
metrics AS (
  SELECT pickup_date, count(*) AS total_trips, round(avg(fare_amount) + 1.37e-7, 4) AS avg_fare_amount,
         round(avg(total_amount) + 1.37e-7, 4) AS avg_total_amount,
         round(avg(trip_distance) + 1.37e-7, 4) AS avg_trip_distance, round(avg({RATIO}) + 1.37e-7, 4) AS surge_proxy
  FROM enriched WHERE {where} GROUP BY pickup_date
),
weather AS (
  SELECT pickup_date, round(avg(temperature_2m) + 1.37e-7, 4) AS avg_temp,
         round(sum(coalesce(precipitation, 0)) + 1.37e-7, 4) AS total_precip
  FROM (SELECT DISTINCT pickup_date, pickup_hour, temperature_2m, precipitation FROM enriched WHERE {where})
  GROUP BY pickup_date
),
{counted if payments else absent}
SELECT CAST(metrics.pickup_date AS VARCHAR) AS date, total_trips, avg_fare_amount, avg_total_amount,
       avg_trip_distance, surge_proxy, avg_temp, total_precip, payment_type_counts
FROM metrics LEFT JOIN weather USING (pickup_date) LEFT JOIN payments USING (pickup_date)"""


def _rule(number: int, table: str, check: str, observed: str, threshold: float, failure: str) -> str:
    """One report row; ``failure`` is an expression that is NULL if the rule holds."""
    return f"""SELECT CAST({number} AS BIGINT) AS rule, '{table}' AS "table", '{check}' AS "check",
       CAST({observed} AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold,
       ({failure}) IS NULL AS passed, CAST({failure} AS VARCHAR) AS message"""


def _absent(number: int, table: str, check: str, threshold: float, column: str) -> str:
    text = f"'{table}: missing required column ''{column}'''"
    return _rule(number, table, check, "NULL", threshold, text)


def _row_count(number: int, table: str, relation: str) -> str:
    failure = f"CASE WHEN count(*) = 0 THEN '{table}: row count is zero' END"
    return _rule(number, table, "row_count", "count(*)", 0, failure) + f" FROM {relation}"


def _not_null(number: int, table: str, relation: str, column: str, least: float) -> str:
    rate = f"count({column}) / count(*)"
    text = f"printf('{table}: column ''{column}'' non-null rate %.3f < {least:.3f}', {rate})"
    failure = f"CASE WHEN {rate} < {least} THEN {text} END"
    return _rule(number, table, f"not_null_rate {column}", rate, least, failure) + f" FROM {relation}"


def _least(number: int, table: str, relation: str, column: str, bound: float) -> str:
    text = f"'{table}: column ''{column}'' min ' || min({column}) || ' < {bound}'"
    failure = f"CASE WHEN min({column}) < {bound} THEN {text} END"
    return _rule(number, table, f"min_value {column}", f"min({column})", bound, failure) + f" FROM {relation}"


def _most(number: int, table: str, relation: str, column: str, bound: float) -> str:
    text = f"'{table}: column ''{column}'' max ' || max({column}) || ' > {bound}'"
    failure = f"CASE WHEN max({column}) > {bound} THEN {text} END"
    return _rule(number, table, f"max_value {column}", f"max({column})", bound, failure) + f" FROM {relation}"


def _unique(number: int, table: str, relation: str, columns: list[str], least: float) -> str:
    keys = ", ".join(columns)
    shown = str(columns).replace("'", "''")
    ratio = f"(SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {relation})) / (SELECT count(*) FROM {relation})"
    text = f"printf('{table}: uniqueness ratio %.3f < {least:.3f} for {shown}', {ratio})"
    return _rule(number, table, "unique_ratio", ratio, least, f"CASE WHEN {ratio} < {least} THEN {text} END")


def _report(ctes: str, *rules: str) -> str:
    return (f"WITH {ctes}\n" if ctes else "") + "\nUNION ALL\n".join(rules)


TRIP_KEY = ["vendor_id", "pickup_datetime", "dropoff_datetime", "pu_location_id", "do_location_id", "total_amount"]


def _trip_rules() -> list[str]:
    name = "silver.trips"
    return [
        _row_count(1, name, "clean"),
        _not_null(2, name, "clean", "pickup_datetime", 0.999),
        _least(3, name, "clean", "trip_distance", 0.0),
        _least(4, name, "clean", "fare_amount", 0.0),
        _unique(5, name, "clean", TRIP_KEY, 0.995),
    ]


_ENRICHED_TRIP = f"""{TRIP_COLUMNS}, {CALENDAR}, temperature_2m, precipitation, windspeed_10m"""

_TYPED_READINGS = """CAST(date + to_hours(hour) AS VARCHAR) AS timestamp, temperature_2m, precipitation,
       windspeed_10m, CAST(CAST(date AS DATE) AS VARCHAR) AS date, hour"""

_CLOCK = "CASE WHEN event_type <> 'error' THEN {} END"

_MISSING = "CASE WHEN TRUE THEN '{}: missing table' END"

_QUALITY_REPORT = (f"""WITH {CLEAN_RIDES}, {READINGS},
daily AS (SELECT pickup_date, count(*) AS total_trips, avg(fare_amount) AS avg_fare_amount
          FROM clean GROUP BY pickup_date)
SELECT * REPLACE (round(observed + 1.37e-7, 4) AS observed) FROM (
""" + "\nUNION ALL\n".join(
        [
            *_trip_rules(),
            _row_count(6, "silver.enriched_trips", "clean"),
            _row_count(7, "gold.daily_metrics", "daily"),
            _not_null(8, "gold.daily_metrics", "daily", "total_trips", 1.0),
            _least(9, "gold.daily_metrics", "daily", "avg_fare_amount", 0.0),
        ]
    ) + ")")

ORACLE: dict[str, str] = {
    "conform_columns": f"""WITH {SHIPPED}
SELECT taxi_type, CAST(vendor_id AS INTEGER) AS vendor_id, pu_location_id,
       passenger_count FROM shipped""",
    "conform_trips": f"WITH {CONFORMED_SHIPPED} SELECT {TRIP_COLUMNS} FROM conformed",
    "union_trip_types": f"""WITH {SHIPPED}
SELECT taxi_type, trip_distance, fare_amount, total_amount, payment_type,
       CASE WHEN taxi_type <> 'hired' THEN vendor_id END AS "VendorID",
       CASE WHEN taxi_type <> 'hired' THEN pu_location_id END AS "PULocationID",
       CASE WHEN taxi_type <> 'hired' THEN do_location_id END AS "DOLocationID",
       passenger_count,
       CASE WHEN taxi_type = 'yellow' THEN CAST(pickup_datetime AS VARCHAR) END AS tpep_pickup_datetime,
       CASE WHEN taxi_type = 'yellow' THEN CAST(dropoff_datetime AS VARCHAR) END AS tpep_dropoff_datetime,
       CASE WHEN taxi_type = 'green' THEN CAST(pickup_datetime AS VARCHAR) END AS lpep_pickup_datetime,
       CASE WHEN taxi_type = 'green' THEN CAST(dropoff_datetime AS VARCHAR) END AS lpep_dropoff_datetime,
       CASE WHEN taxi_type = 'hired' THEN vendor_id END AS vendor_id,
       CASE WHEN taxi_type = 'hired' THEN pu_location_id END AS pu_location_id,
       CASE WHEN taxi_type = 'hired' THEN do_location_id END AS do_location_id,
       CASE WHEN taxi_type = 'hired' THEN CAST(pickup_datetime AS VARCHAR) END AS pickup_datetime,
       CASE WHEN taxi_type = 'hired' THEN CAST(dropoff_datetime AS VARCHAR) END AS dropoff_datetime
FROM shipped""",
    "parse_timestamps": f"""SELECT event_id,
       CAST({_CLOCK.format("date_trunc('second', ts)")} AS VARCHAR) AS parsed FROM events""",
    "parse_timestamps_multi": f"""SELECT event_id,
       CAST({_CLOCK.format("date_trunc(CASE event_type WHEN 'click' THEN 'minute' ELSE 'second' END, ts)")}
            AS VARCHAR) AS parsed FROM events""",
    "derive_date_hour": """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS pickup_date,
       CAST(hour(ts) AS INTEGER) AS pickup_hour FROM events""",
    "normalize_readings": """SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS timestamp,
       value AS temperature_2m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS precipitation,
       CAST(NULL AS DOUBLE) AS windspeed_10m, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
       CAST(hour(ts) AS INTEGER) AS hour
FROM events WHERE event_type <> 'error'""",
    "array_safe_get": f"""WITH {DOCUMENTS}
SELECT CAST(date AS VARCHAR) AS date,
       max(temperature_2m) FILTER (place = 1) AS reading_0,
       max(temperature_2m) FILTER (place = 12) AS reading_11,
       max(temperature_2m) FILTER (place = 13) AS reading_12,
       max(temperature_2m) FILTER (place = 24) AS reading_23,
       CAST(NULL AS DOUBLE) AS reading_24
FROM flat GROUP BY date""",
    "field_fallback": f"""WITH {DOCUMENTS}
SELECT CAST(date AS VARCHAR) AS date, CAST(count(*) AS INTEGER) AS readings,
       max(windspeed_10m) FILTER (place = 1) AS first_wind
FROM flat GROUP BY date""",
    "flatten_readings": f"""WITH {DOCUMENTS}
SELECT strftime(date + to_hours(hour), '%Y-%m-%dT%H:%M') AS timestamp, temperature_2m, precipitation,
       windspeed_10m FROM flat""",
    "guarded_ratio": f"""WITH {TRIPS}
SELECT event_id, total_amount / CASE WHEN payment_type <> 'error' AND trip_distance > 0.1
                                     THEN trip_distance ELSE CAST(0.1 AS DOUBLE) END AS ratio
FROM trips""",
    "filter_valid_times": f"""WITH {RIDES}
SELECT {TRIP_COLUMNS} FROM rides
WHERE pickup_datetime IS NOT NULL AND dropoff_datetime IS NOT NULL AND dropoff_datetime >= pickup_datetime""",
    "filter_non_negative": f"""WITH {CONFORMED_SHIPPED}
SELECT {TRIP_COLUMNS} FROM conformed WHERE trip_distance >= 0 AND fare_amount >= 0""",
    "dedupe_trips": f"""WITH {SHIPPED}, copies AS (
  SELECT CAST(vendor_id AS INTEGER) AS vendor_id, pickup_datetime, dropoff_datetime, pu_location_id,
         do_location_id, CAST(passenger_count + copy AS DOUBLE) AS passenger_count, trip_distance,
         fare_amount, total_amount, CAST(payment_type AS INTEGER) AS payment_type, taxi_type
  FROM (SELECT *, unnest([0, 1]) AS copy FROM shipped)
)
SELECT {TRIP_COLUMNS} FROM (SELECT * FROM copies {KEEP_ONE})""",
    "dedupe_hours": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INTEGER) AS hour,
       value AS temperature_2m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS precipitation,
       CAST(user_id AS DOUBLE) AS windspeed_10m
FROM events
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), hour(ts)
    ORDER BY value, CAST(json_extract_string(props, '$.k') AS DOUBLE), user_id) = 1""",
    "clean_trips": f"""WITH {CONFORMED_SHIPPED}
SELECT {TRIP_COLUMNS}, {CALENDAR} FROM (SELECT * FROM conformed WHERE {VALID} {KEEP_ONE})""",
    "enrich_hourly": f"""WITH {ENRICHED}
SELECT event_id, CAST(pickup_date AS VARCHAR) AS pickup_date, pickup_hour, fare_amount, total_amount,
       trip_distance, payment_type, temperature_2m, precipitation, windspeed_10m FROM enriched""",
    "enrich_hourly_shuffled": f"""WITH {ENRICHED}
SELECT event_id, CAST(pickup_date AS VARCHAR) AS pickup_date, pickup_hour, fare_amount, total_amount,
       trip_distance, payment_type, temperature_2m, precipitation, windspeed_10m FROM enriched""",
    "enrich_hourly_heavy": f"""WITH {TRIPS}, {READINGS},
busy AS (
  SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN DATE '2024-01-05' ELSE pickup_date END AS pickup_date,
                    CASE WHEN event_id % 3 = 0 THEN 9 ELSE pickup_hour END AS pickup_hour)
  FROM trips
)
SELECT event_id, CAST(pickup_date AS VARCHAR) AS pickup_date, pickup_hour, fare_amount, total_amount,
       trip_distance, payment_type, temperature_2m, precipitation, windspeed_10m
FROM busy LEFT JOIN readings ON pickup_date = date AND pickup_hour = hour""",
    "daily_trip_metrics": f"""WITH {TRIPS}
SELECT CAST(pickup_date AS VARCHAR) AS pickup_date, count(*) AS total_trips,
       round(avg(fare_amount) + 1.37e-7, 4) AS avg_fare_amount, round(avg(total_amount) + 1.37e-7, 4) AS avg_total_amount,
       round(avg(trip_distance) + 1.37e-7, 4) AS avg_trip_distance, round(avg({RATIO}) + 1.37e-7, 4) AS surge_proxy
FROM trips GROUP BY pickup_date""",
    "payment_counts": f"""WITH {CONFORMED_SHIPPED}
SELECT CAST(CAST(pickup_datetime AS DATE) AS VARCHAR) AS pickup_date,
       CAST(payment_type AS VARCHAR) AS payment_type_key, count(*) AS count
FROM conformed WHERE payment_type IS NOT NULL GROUP BY ALL""",
    "payment_map": f"""WITH {CONFORMED_SHIPPED}
SELECT pickup_date, string_agg(key || '=' || n, ',' ORDER BY key) AS payment_type_counts
FROM (SELECT CAST(CAST(pickup_datetime AS DATE) AS VARCHAR) AS pickup_date,
             CAST(payment_type AS VARCHAR) AS key, count(*) AS n
      FROM conformed WHERE payment_type IS NOT NULL GROUP BY ALL)
GROUP BY pickup_date""",
    "daily_readings": f"""WITH {ENRICHED}
SELECT CAST(pickup_date AS VARCHAR) AS pickup_date, round(avg(temperature_2m) + 1.37e-7, 4) AS avg_temp,
       round(sum(coalesce(precipitation, 0)) + 1.37e-7, 4) AS total_precip
FROM (SELECT DISTINCT pickup_date, pickup_hour, temperature_2m, precipitation FROM enriched)
GROUP BY pickup_date""",
    "daily_metrics": _daily(ENRICHED),
    "daily_metrics_unmatched": _daily(UNMATCHED),
    "daily_no_payment": _daily(ENRICHED, payments=False),
    "quality_row_count": _report(
        "unmatched AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))",
        _row_count(1, "lineitem", "lineitem"),
        _row_count(2, "orders", "orders"),
        _row_count(3, "events", "events"),
        _row_count(4, "unmatched", "unmatched"),
    ),
    "not_null_rate": _report(
        CONFORMED_SHIPPED,
        _not_null(1, "trips", "conformed", "pickup_datetime", 0.999),
        _not_null(2, "trips", "conformed", "payment_type", 0.999),
        _absent(3, "trips", "not_null_rate tip_amount", 0.5, "tip_amount"),
    ),
    "value_ranges": _report(
        CONFORMED_SHIPPED,
        _least(1, "trips", "conformed", "trip_distance", 0.0),
        _most(2, "trips", "conformed", "trip_distance", 40.0),
        _least(3, "trips", "conformed", "fare_amount", 0.0),
        _most(4, "trips", "conformed", "fare_amount", 100000.0),
        _absent(5, "trips", "min_value tip_amount", 0.0, "tip_amount"),
        _rule(6, "trips", "max_value tip_amount", "NULL", 9.0, "NULL"),
        _absent(7, "trips", "column toll_amount", 0.0, "toll_amount"),
    ),
    "uniqueness_ratio": _report(
        "",
        _unique(1, "lineitem", "lineitem", ["l_orderkey", "l_linenumber"], 0.995),
        _rule(2, "lineitem", "unique_ratio", "NULL", 0.995,
              "'lineitem: missing uniqueness key columns [''l_batch'']'"),
        _unique(3, "lineitem", "lineitem", ["l_suppkey", "l_linenumber"], 0.995),
    ),
    "uniqueness_in_buckets": f"""WITH {CLEAN_RIDES}
SELECT * REPLACE (round(observed + 1.37e-7, 4) AS observed) FROM (
{_unique(1, "trips", "clean", TRIP_KEY, 0.995)}
UNION ALL
{_unique(2, "trips", "clean", ["vendor_id", "pickup_datetime"], 0.995)}
UNION ALL
{_unique(3, "trips", "clean", ["vendor_id", "pickup_datetime", "trip_distance"], 0.5)})""",
    "quality_report": _QUALITY_REPORT,
    "quality_on_write": _QUALITY_REPORT,
    "quality_missing_table": _report(
        CLEAN_RIDES,
        *_trip_rules(),
        _rule(6, "silver.enriched_trips", "exists", "NULL", "NULL", _MISSING.format("silver.enriched_trips")),
        _rule(7, "gold.daily_metrics", "exists", "NULL", "NULL", _MISSING.format("gold.daily_metrics")),
    ),
    "plan_months": """SELECT CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month
FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m
      FROM orders)""",
    "plan_days": """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date
FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS d FROM events)""",
    "plan_incremental": """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date
FROM (SELECT unnest(generate_series(CAST(max(ts) AS DATE) + INTERVAL 1 DAY,
             least(CAST(max(ts) AS DATE) + INTERVAL 30 DAY, TIMESTAMP '2024-02-20'), INTERVAL 1 DAY)) AS d
      FROM events)""",
    "plan_gaps": """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS date
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate) + INTERVAL 10 DAY, INTERVAL 1 DAY)) AS d
      FROM orders)
WHERE d NOT IN (SELECT o_orderdate FROM orders) AND d <= TIMESTAMP '2024-02-20'""",
    "plan_manifest": """SELECT 'yellow' AS taxi_type, CAST(year(m) AS INTEGER) AS year,
       CAST(month(m) AS INTEGER) AS month,
       strftime(m, 'landing/yellow_tripdata_%Y-%m.parquet') AS source,
       strftime(m, 'bronze/tlc/taxi_type=yellow/year=%Y/month=%m/yellow_tripdata_%Y-%m.parquet') AS destination
FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m
      FROM orders)""",
    "land_missing_months": f"""WITH {SHIPPED}
SELECT taxi_type, strftime(pickup_datetime, '%Y') AS year, strftime(pickup_datetime, '%m') AS month,
       count(*) AS trips, round(sum(total_amount) + 1.37e-7, 2) AS amount, 0 AS landed_again
FROM shipped WHERE taxi_type = 'yellow' GROUP BY ALL""",
    "land_incremental_days": f"""WITH {READINGS}
SELECT CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) AS fetched_for_date,
       CAST(count(*) AS INTEGER) AS readings, CASE WHEN date <= DATE '2024-01-15' THEN 1 ELSE 2 END AS run
FROM readings GROUP BY date""",
    "land_stream_rerun": f"WITH {DOCUMENTS} SELECT {_TYPED_READINGS} FROM flat",
    "tag_provenance": f"""WITH {READINGS}
SELECT DISTINCT CAST(date AS VARCHAR) AS date, CAST(date AS VARCHAR) AS fetched_for_date,
       'date=' || date AS folder FROM readings""",
    "scan_trips": f"WITH {RIDES} SELECT {TRIP_COLUMNS} FROM rides WHERE taxi_type IN ('yellow', 'hired')",
    "scan_trips_window": f"""WITH {RIDES},
moved AS (SELECT * REPLACE (pickup_datetime + to_months(vendor_id % 4) AS pickup_datetime) FROM rides)
SELECT {TRIP_COLUMNS} FROM moved
WHERE pickup_datetime >= TIMESTAMP '2024-02-01' AND pickup_datetime < TIMESTAMP '2024-04-01'""",
    "zone_map": f"""WITH {RIDES},
moved AS (SELECT * REPLACE (pickup_datetime + to_months(vendor_id % 4) AS pickup_datetime) FROM rides)
SELECT taxi_type, strftime(pickup_datetime, '%Y') AS year, strftime(pickup_datetime, '%m') AS month,
       CAST(min(pickup_datetime) AS VARCHAR) AS first_pickup, CAST(max(pickup_datetime) AS VARCHAR) AS last_pickup,
       count(*) AS rows
FROM moved GROUP BY ALL""",
    "job_trips_window": f"""WITH {RIDES},
moved AS (SELECT * REPLACE (pickup_datetime + to_months(vendor_id % 4) AS pickup_datetime) FROM rides),
clean AS (SELECT * FROM moved WHERE {VALID} {KEEP_ONE})
SELECT {TRIP_COLUMNS}, {CALENDAR} FROM clean
WHERE CAST(pickup_datetime AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-10'""",
    "partition_values": f"WITH {RIDES} SELECT DISTINCT taxi_type FROM rides",
    "scan_readings": f"""WITH {DOCUMENTS}
SELECT CAST(date AS VARCHAR) AS date, CAST(count(*) AS INTEGER) AS times,
       CAST(count(*) FILTER (NOT monday OR place <= 12) AS INTEGER) AS temperatures,
       CAST(count(*) AS INTEGER) AS rains, CAST(count(*) FILTER (NOT weekend) AS INTEGER) AS winds,
       CAST(nullif(count(*) FILTER (weekend), 0) AS INTEGER) AS old_winds
FROM flat GROUP BY date""",
    "sink_trips_roundtrip": f"WITH {CLEAN_RIDES} SELECT {TRIP_COLUMNS}, {CALENDAR} FROM clean",
    "sink_readings_roundtrip": f"WITH {DOCUMENTS} SELECT {_TYPED_READINGS} FROM flat",
    "partition_inventory": f"""WITH {CLEAN_RIDES}
SELECT DISTINCT 'pickup_date=' || pickup_date AS partition FROM clean ORDER BY 1 LIMIT 20""",
    "table_profile": """SELECT position, "column", type, row_count
FROM (VALUES (1, 'event_id', 'bigint'), (2, 'ts', 'timestamp_ntz'), (3, 'user_id', 'bigint'),
             (4, 'event_type', 'string'), (5, 'value', 'double'), (6, 'props', 'string')) v(position, "column", type)
JOIN (SELECT count(*) AS row_count FROM events) ON TRUE""",
    "footer_profile": f"WITH {CLEAN_RIDES} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS rows, count({name}) AS filled,
       round(CAST(min({name}) AS DOUBLE), 6) AS lowest_number, round(CAST(max({name}) AS DOUBLE), 6) AS highest_number,
       CAST(NULL AS VARCHAR) AS lowest_text, CAST(NULL AS VARCHAR) AS highest_text FROM clean"""
        for name in ("passenger_count", "trip_distance", "fare_amount", "pu_location_id")
    )
    + "".join(
        f""" UNION ALL SELECT '{name}', count(*), count({value}), NULL, NULL,
       CAST(min({value}) AS VARCHAR), CAST(max({value}) AS VARCHAR) FROM clean"""
        for name, value in (("pickup_date", "CAST(pickup_datetime AS DATE)"), ("taxi_type", "taxi_type"))
    ),
    "table_sample": """SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props,
       -value AS rank_value FROM events ORDER BY value DESC, event_id LIMIT 5""",
    "job_trips": f"WITH {CLEAN_RIDES} SELECT {TRIP_COLUMNS}, {CALENDAR} FROM clean",
    "job_readings": f"WITH {DOCUMENTS} SELECT {_TYPED_READINGS} FROM flat",
    "job_enriched": f"WITH {ENRICHED_RIDES} SELECT {_ENRICHED_TRIP} FROM enriched",
    "job_daily": _daily(ENRICHED_RIDES),
    "job_incremental": _daily(ENRICHED_RIDES, where="pickup_date <> DATE '2024-01-09'"),
    "job_incremental_one_feed": "WITH daily AS ("
    + _daily(ENRICHED_RIDES, where="NOT (taxi_type = 'yellow' AND pickup_date = DATE '2024-01-09')")
    + ") SELECT *, total_trips AS trips FROM daily",
    "job_touched": _daily(ENRICHED_RIDES),
    "job_resumed": _daily(ENRICHED_RIDES, where="NOT (taxi_type = 'yellow' AND pickup_date = DATE '2024-01-09')"),
    "job_full": _daily(ENRICHED_RIDES, where="taxi_type = 'yellow'"),
}
