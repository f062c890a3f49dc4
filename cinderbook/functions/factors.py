"""Emission factors and the two derived emission columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.schemas import ENERGY_CO2E, TRIP_CO2E

# Emission per kWh by energy source; unknown sources count as zero.
ENERGY_FACTORS = {
    "electricity": Decimal("0.0004"),
    "gas": Decimal("0.0002"),
    "fuel": Decimal("0.0003"),
    "steam": Decimal("0.0001"),
}
UNKNOWN_SOURCE_FACTOR = Decimal("0")

# Emission per km by travel mode; unknown modes count as 0.15.
TRIP_FACTORS = {
    "car": Decimal("0.21"),
    "bus": Decimal("0.08"),
    "air": Decimal("0.25"),
    "train": Decimal("0.04"),
    "metro": Decimal("0.03"),
    "bike": Decimal("0"),
    "walk": Decimal("0"),
}
UNKNOWN_MODE_FACTOR = Decimal("0.15")

# The type of factors given as text.
TEXT_FACTOR = "decimal(18,10)"


def _emission(key: str, amount: str, factors: dict, default: Decimal) -> Column:
    cases = " ".join(f"WHEN '{name}' THEN {amount} * {factor}BD" for name, factor in factors.items())
    return F.expr(f"CASE {key} {cases} ELSE {amount} * {default}BD END")


def energy_co2e(source: str = "source", kwh: str = "consumption_kwh") -> Column:
    """Emission of a reading, rounded half up to the column's scale."""
    return _emission(source, kwh, ENERGY_FACTORS, UNKNOWN_SOURCE_FACTOR).cast(ENERGY_CO2E)


def trip_co2e(mode: str = "mode", km: str = "distance_km") -> Column:
    """Emission of a trip, rounded half up to the column's scale."""
    return _emission(mode, km, TRIP_FACTORS, UNKNOWN_MODE_FACTOR).cast(TRIP_CO2E)


def with_energy_co2e(df: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Set `co2e_emitted` of readings, from the built-in factors or a (key, factor) table."""
    if factors is None:
        return df.withColumn("co2e_emitted", energy_co2e())
    return _with_factor_table(
        df, factors, "source", ENERGY_FACTORS, "consumption_kwh", UNKNOWN_SOURCE_FACTOR, ENERGY_CO2E
    )


def with_trip_co2e(df: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Set `co2e_emitted` of trips, from the built-in factors or a (key, factor) table."""
    if factors is None:
        return df.withColumn("co2e_emitted", trip_co2e())
    return _with_factor_table(
        df, factors, "mode", TRIP_FACTORS, "distance_km", UNKNOWN_MODE_FACTOR, TRIP_CO2E
    )


def _with_factor_table(df, factors, key, keys, amount, default, kind) -> DataFrame:
    # Only keys that facts may hold, one row each: the join cannot multiply facts, and the table is small enough to send to
    # every task whatever its size was.  Factors keep their own scale; only the emission is rounded.
    kind_given = factors.schema["factor"].dataType
    if isinstance(kind_given, T.StringType):
        factors = factors.withColumn("factor", F.col("factor").cast(TEXT_FACTOR))
    elif not isinstance(kind_given, T.DecimalType):
        raise TypeError("factors must be decimals, or decimals as text")
    known = factors.filter(F.col("key").isin(list(keys)))
    table = known.groupBy(F.col("key").alias("_factor_key")).agg(
        F.max("factor").alias("_factor"),
        F.count_distinct("factor").alias("_variants"),
    ).withColumn(
        "_factor",
        F.when(F.col("_variants") <= 1, F.col("_factor")).otherwise(
            F.raise_error(F.lit("factor table holds two factors for one key"))
        ),
    ).drop("_variants")
    rated = F.col(amount) * F.coalesce(F.col("_factor"), F.lit(default))
    return (
        df.join(F.broadcast(table), df[key] == table["_factor_key"], "left")
        .withColumn("co2e_emitted", rated.cast(kind))
        .drop("_factor_key", "_factor")
    )
