"""Data-quality rules: one report row per rule, few passes per table, and a gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyfare.schemas import TRIP_KEY

# The messages of failed rules.
ZERO_ROWS = "{table}: row count is zero"
MISSING_TABLE = "{table}: missing table"
MISSING_COLUMN = "{table}: missing required column '{column}'"
MISSING_KEYS = "{table}: missing uniqueness key columns {columns}"
RATE_OF_NOTHING = "{table}: cannot evaluate null-rate on empty table"
RATE_TOO_LOW = "{table}: column '{column}' non-null rate %s < {threshold:.3f}"
VALUE_TOO_LOW = "{table}: column '{column}' min %s < {threshold}"
VALUE_TOO_HIGH = "{table}: column '{column}' max %s > {threshold}"
KEYS_OF_NOTHING = "{table}: cannot evaluate uniqueness on empty table"
KEYS_REPEAT = "{table}: uniqueness ratio %s < {threshold:.3f} for {columns}"

REPORT = (
    "rule bigint, table string, check string, observed double, threshold double, "
    "passed boolean, message string"
)


@dataclass(frozen=True)
class Rule:
    """A rule on one table, as aggregates and a verdict over their values."""

    check: str = ""
    columns: tuple[str, ...] = ()
    threshold: float = 0.0
    # whether an earlier rule reports that the column is missing
    follows: bool = False

    def aggregates(self) -> dict[str, Column]:
        """What to measure; ``rows`` is measured for every table."""
        return {}

    def observed(self, value: Mapping[str, Column]) -> Column:
        raise NotImplementedError

    def failure(self, table: str, value: Mapping[str, Column]) -> Column:
        """The failure message, NULL if the rule holds."""
        raise NotImplementedError

    def absent(self, table: str, columns: Sequence[str]) -> str:
        """The failure message for columns that the table does not have."""
        return MISSING_COLUMN.format(table=table, column=columns[0])

    def text(self, message: str, table: str, shown: Column | None = None) -> Column:
        """The message with its names and, in place of ``%s``, the shown value.

        The parts are joined, not printed: a name may hold any character.
        """
        filled = [
            part.format(
                table=table,
                column=self.columns[0] if self.columns else "",
                columns=list(self.columns),
                threshold=self.threshold,
            )
            for part in message.split("%s")
        ]
        return F.lit(filled[0]) if shown is None else F.concat(F.lit(filled[0]), shown, F.lit(filled[1]))


def _three_decimals(rate: Column) -> Column:
    """A rate between 0 and 1 as text, rounded from its exact binary value.

    ``format_string`` rounds the printed digits instead: it shows the double
    0.8085, which is just below that number, as 0.809.
    """

    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b))

    unit = 2**60
    scaled = (rate * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)") * 1000
    # adding half a unit rounds up; an exact half goes to the even neighbour
    even_half = F.lit(unit // 2 - 1) + div(scaled, unit) % 2
    thousandths = div(scaled + even_half, unit)
    return F.format_string("%d.%03d", div(thousandths, 1000), thousandths % 1000)


@dataclass(frozen=True)
class NonEmpty(Rule):
    check: str = "row_count"

    def observed(self, value):
        return value["rows"]

    def failure(self, table, value):
        return F.when(value["rows"] == 0, self.text(ZERO_ROWS, table))


@dataclass(frozen=True)
class HasColumn(Rule):
    """The column exists, whatever it holds."""

    check: str = "column"

    def observed(self, value):
        return F.lit(None)

    def failure(self, table, value):
        return F.lit(None)


@dataclass(frozen=True)
class NotNullRate(Rule):
    """Share of non-NULL values is at least ``threshold``; an empty table fails."""

    check: str = "not_null_rate"

    def aggregates(self):
        return {"filled": F.count(F.col(self.columns[0]))}

    def observed(self, value):
        return F.try_divide(value["filled"], value["rows"])

    def failure(self, table, value):
        rate = self.observed(value)
        low = self.text(RATE_TOO_LOW, table, _three_decimals(rate))
        nothing = self.text(RATE_OF_NOTHING, table)
        return F.when(value["rows"] == 0, nothing).when(rate < self.threshold, low)


@dataclass(frozen=True)
class AtLeast(Rule):
    """No value below ``threshold``; a table without values passes."""

    check: str = "min_value"

    def aggregates(self):
        return {"lowest": F.min(F.col(self.columns[0]))}

    def observed(self, value):
        return value["lowest"].cast("double")

    def failure(self, table, value):
        shown = value["lowest"].cast("string")
        below = self.observed(value) < self.threshold
        return F.when(below, self.text(VALUE_TOO_LOW, table, shown))


@dataclass(frozen=True)
class AtMost(Rule):
    """No value above ``threshold``; NaN is not above, a table without values passes."""

    check: str = "max_value"

    def aggregates(self):
        return {"highest": F.max(F.col(self.columns[0]))}

    def observed(self, value):
        return value["highest"].cast("double")

    def failure(self, table, value):
        shown = value["highest"].cast("string")
        above = (self.observed(value) > self.threshold) & ~F.isnan(self.observed(value))
        return F.when(above, self.text(VALUE_TOO_HIGH, table, shown))


@dataclass(frozen=True)
class UniqueRatio(Rule):
    """Distinct keys per row at least ``threshold``; an empty table fails.

    The key is counted as one struct, so keys with NULLs count like any other.
    """

    check: str = "unique_ratio"

    def aggregates(self):
        return {"keys": F.count_distinct(F.struct(*self.columns))}

    def observed(self, value):
        return F.try_divide(value["keys"], value["rows"])

    def failure(self, table, value):
        ratio = self.observed(value)
        low = self.text(KEYS_REPEAT, table, _three_decimals(ratio))
        nothing = self.text(KEYS_OF_NOTHING, table)
        return F.when(value["rows"] == 0, nothing).when(ratio < self.threshold, low)

    def absent(self, table, columns):
        return MISSING_KEYS.format(table=table, columns=list(columns))


def value_range(column: str, low: float | None = None, high: float | None = None) -> list[Rule]:
    """The rules for a range that may be open at either end.

    A missing column fails the first of them only, and the one rule of a range
    that is open at both ends.
    """
    rules: list[Rule] = []
    if low is not None:
        rules.append(AtLeast(columns=(column,), threshold=low))
    if high is not None:
        rules.append(AtMost(columns=(column,), threshold=high, follows=low is not None))
    return rules or [HasColumn(columns=(column,))]


# The rules and thresholds of the standard report.
STANDARD_RULES: dict[str, list[Rule]] = {
    "silver.trips": [
        NonEmpty(),
        NotNullRate(columns=("pickup_datetime",), threshold=0.999),
        *value_range("trip_distance", low=0.0),
        *value_range("fare_amount", low=0.0),
        UniqueRatio(columns=TRIP_KEY, threshold=0.995),
    ],
    "silver.enriched_trips": [NonEmpty()],
    "gold.daily_metrics": [
        NonEmpty(),
        NotNullRate(columns=("total_trips",), threshold=1.0),
        *value_range("avg_fare_amount", low=0.0),
    ],
}


def check_table(
    df: DataFrame, table: str, rules: Sequence[Rule], first: int = 1, apart: Sequence[Column] = ()
) -> DataFrame:
    """The report of one table in one pass, plus one for each uniqueness rule.

    A uniqueness rule shuffles every key. On its own it reads and moves the key
    columns only; together with the others, each key would carry their partial
    results along. Nothing is moved where ``df`` scans a table in buckets of
    columns that the key holds (``sources.buckets``).

    ``apart`` are conditions of which each row meets exactly one, such that no
    key of the rules has rows under two of them: a month each of a table by day
    whose keys hold the time. Keys are then counted under each by itself, which
    gives a table in buckets a task for each bucket and condition.
    """
    numbered = list(enumerate(rules, start=first))
    alone = [(n, rule) for n, rule in numbered if isinstance(rule, UniqueRatio)]
    shared = [(n, rule) for n, rule in numbered if not isinstance(rule, UniqueRatio)]
    reports = [_one_pass(df, table, shared)] if shared else []
    reports += [_unique_pass(df, table, one, apart) for one in alone]
    return reduce(DataFrame.unionByName, reports)


def _unique_pass(df: DataFrame, table: str, numbered: tuple[int, UniqueRatio], apart: Sequence[Column]) -> DataFrame:
    """One uniqueness rule by groups of the key's own columns, which may be in place already."""
    number, rule = numbered
    if any(name not in df.columns for name in rule.columns):
        return _one_pass(df, table, [numbered])
    parts = [df.where(condition) for condition in apart] or [df]
    # each part down to one row before they come together
    counted = [
        part.groupBy(*rule.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("keys"))
        for part in parts
    ]
    total = F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("keys").alias("keys")
    value = {"rows": F.col("rows"), "keys": F.col("keys")}
    row = _row(number, table, rule, rule.observed(value), rule.failure(table, value))
    return reduce(DataFrame.unionAll, counted).agg(*total).select(F.inline(F.array(row)))


def _one_pass(df: DataFrame, table: str, numbered: Sequence[tuple[int, Rule]]) -> DataFrame:
    measured, report = _measures(df.columns, table, numbered)
    return df.agg(*measured).select(F.inline(F.array(*report)))


def _measures(
    columns: Sequence[str], table: str, numbered: Sequence[tuple[int, Rule]]
) -> tuple[list[Column], list[Column]]:
    """The aggregates that rules need, and the report's rows over them."""
    measured: dict[str, Column] = {"rows": F.count(F.lit(1))}
    report: list[Column] = []
    for number, rule in numbered:
        absent = [name for name in rule.columns if name not in columns]
        if absent:
            message = F.lit(None if rule.follows else rule.absent(table, absent))
            report.append(_row(number, table, rule, F.lit(None), message))
            continue
        value = {"rows": F.col("rows")}
        for name, aggregate in rule.aggregates().items():
            measured[f"{name}_{number}"] = aggregate
            value[name] = F.col(f"{name}_{number}")
        report.append(_row(number, table, rule, rule.observed(value), rule.failure(table, value)))
    return [column.alias(name) for name, column in measured.items()], report


class Measured:
    """The rules of a table, measured while it is written instead of by a scan of it afterwards.

    Uniqueness rules are left to the scan: their keys need a shuffle of their own.
    """

    def __init__(self, table: str, rules: Mapping[str, Sequence[Rule]] | None = None) -> None:
        self.table, self.observation = table, Observation()
        first = 1
        for name, own in (STANDARD_RULES if rules is None else rules).items():
            if name == table:
                numbered = list(enumerate(own, start=first))
            first += len(own)
        self.numbered = [(n, rule) for n, rule in numbered if not isinstance(rule, UniqueRatio)]
        self.left = [(n, rule) for n, rule in numbered if isinstance(rule, UniqueRatio)]
        self.schema: StructType | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        """The rows to write, with the metrics that the rules need."""
        measured, self.report_rows = _measures(df.columns, self.table, self.numbered)
        self.schema = df.agg(*measured).schema
        return df.observe(self.observation, *measured)

    def report(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        """The report of the written rows; ``df`` is the stored table, read for uniqueness rules only."""
        found = self.observation.get
        values = spark.createDataFrame([tuple(found[f.name] for f in self.schema)], self.schema)
        passes = [values.select(F.inline(F.array(*self.report_rows)))] if self.report_rows else []
        return reduce(DataFrame.unionByName, [*passes, *[_unique_pass(df, self.table, one, ()) for one in self.left]])


def _row(number: int, table: str, rule: Rule, observed: Column, failure: Column) -> Column:
    check = " ".join([rule.check, *rule.columns]) if len(rule.columns) == 1 else rule.check
    return F.struct(
        F.lit(number).cast("bigint").alias("rule"),
        F.lit(table).alias("table"),
        F.lit(check).alias("check"),
        observed.cast("double").alias("observed"),
        F.lit(float(rule.threshold)).alias("threshold"),
        failure.isNull().alias("passed"),
        failure.cast("string").alias("message"),
    )


def quality_report(
    spark: SparkSession,
    tables: Mapping[str, DataFrame | None],
    rules: Mapping[str, Sequence[Rule]] = STANDARD_RULES,
    measured: Mapping[str, Measured] | None = None,
) -> DataFrame:
    """All rules of all tables. A table that is None fails once, the others still run.

    Tables in ``measured`` had these rules measured when they were written.
    """
    reports: list[DataFrame] = []
    first = 1
    for table, table_rules in rules.items():
        df = tables.get(table)
        if df is None:
            gone = [(first, table, "exists", None, None, False, MISSING_TABLE.format(table=table))]
            reports.append(spark.createDataFrame(gone, REPORT))
        elif measured and table in measured:
            reports.append(measured[table].report(spark, df))
        else:
            reports.append(check_table(df, table, table_rules, first))
        first += len(table_rules)
    return reduce(DataFrame.unionByName, reports)


def failed_checks(report: DataFrame) -> list[str]:
    """Messages of the failed rules, in rule order: at most one per rule."""
    return [r.message for r in report.filter("not passed").orderBy("rule").collect()]


def require_quality(report: DataFrame) -> None:
    """Stop the job if any rule failed."""
    messages = failed_checks(report)
    if messages:
        raise RuntimeError("Quality checks failed: " + "; ".join(messages))
