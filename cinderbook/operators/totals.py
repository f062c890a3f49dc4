"""Per-key totals of the two facts, the first step of nearly every report.

Facts are aggregated before they meet a dimension.  The map side reduces a building or user
holding a third of all rows to one row per task, the shuffle moves one row per key and task, and
the join that follows is between two small sides already hashed on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark adds up decimals of at most eight digits in a long, wider ones as big decimals.
LONG_SUM_DIGITS = 8

_TOTAL_TYPES = {
    "records": "bigint",
    "trips": "bigint",
    "kwh": "decimal(24,2)",
    "km": "decimal(24,2)",
    "co2e": "decimal(24,4)",
}


def row_count() -> Column:
    """Primary keys are never NULL, so COUNT(key) is COUNT(*) and the key column stays unread."""
    return F.count(F.lit(1))


def exact_sum(fact: DataFrame, column: str) -> Column:
    """The sum of a decimal column, exact and of the type Spark gives it.

    A ten-digit measure is added up as whole part and fraction, each in a long: about twice as
    fast as one sum of big decimals.  The fraction has eight digits, so its sum has eighteen: room
    for 10^14 rows of the largest four-digit fraction.
    """
    kind = fact.schema[column].dataType
    if kind.precision <= LONG_SUM_DIGITS:
        return F.sum(column)
    digits, scale = kind.precision, kind.scale
    whole = f"CAST({column} AS BIGINT)"
    fraction = f"CAST({column} - CAST({whole} AS DECIMAL({digits},0)) AS DECIMAL({LONG_SUM_DIGITS},{scale}))"
    return F.expr(f"CAST(sum({whole}) + sum({fraction}) AS DECIMAL({digits + 10},{scale}))")


def co2e_sum(fact: DataFrame) -> Column:
    """Emission total of readings or trips in one common type; NULL without rows."""
    return exact_sum(fact, "co2e_emitted").cast("decimal(24,4)")


def energy_totals(energy: DataFrame, *keys: str | Column) -> DataFrame:
    return energy.groupBy(*keys).agg(
        row_count().alias("records"),
        exact_sum(energy, "consumption_kwh").alias("kwh"),
        exact_sum(energy, "co2e_emitted").alias("co2e"),
    )


def trip_totals(trips: DataFrame, *keys: str | Column) -> DataFrame:
    return trips.groupBy(*keys).agg(
        row_count().alias("trips"),
        F.sum("distance_km").alias("km"),
        F.sum("co2e_emitted").alias("co2e"),
    )


def co2e_totals(fact: DataFrame, *keys: str | Column) -> DataFrame:
    return fact.groupBy(*keys).agg(exact_sum(fact, "co2e_emitted").alias("co2e"))


def roll_up(totals: DataFrame, *keys: str) -> DataFrame:
    """Totals by fewer keys, with the same columns as before."""
    measures = [m for m in _TOTAL_TYPES if m in totals.columns]
    return totals.groupBy(*keys).agg(
        *[F.sum(m).cast(_TOTAL_TYPES[m]).alias(m) for m in measures]
    )


def one_row(spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """Side by side the single rows of several global aggregates, each as a struct column.

    Scalar subqueries: no join, and each source is scanned once.
    """
    columns = []
    for name, frame in frames.items():
        packed = frame.select(F.struct(*frame.columns).alias("packed"))
        columns.append(packed.scalar().alias(name))
    return spark.range(0, 1, 1, 1).select(*columns)
