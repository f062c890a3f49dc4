"""The five-table model: explicit schemas, enumerations and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the data model.
ENERGY_SOURCES = ("electricity", "gas", "fuel", "steam")
TRIP_MODES = ("car", "bus", "bike", "walk", "air", "train", "metro")
ROLES = ("admin", "user", "guest")
STATUSES = ("planned", "active", "completed", "cancelled")

# Measure types.  Sums of them widen by ten digits in Spark and stay exact.
KWH = T.DecimalType(10, 2)
ENERGY_CO2E = T.DecimalType(10, 4)
KM = T.DecimalType(8, 2)
TRIP_CO2E = T.DecimalType(8, 4)
REDUCTION = T.DecimalType(10, 2)

# Facts are written partitioned by the first day of the month of their time column.
MONTH_COLUMN = "fact_month"

_NTZ = T.TimestampNTZType()
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


BUILDINGS = _table(
    ("building_id", T.StringType()),
    ("name", T.StringType()),
    ("sq_footage", T.IntegerType()),
    ("primary_use", T.StringType()),
    ("location_gps", _POINT),
    ("created_at", _NTZ),
    ("updated_at", _NTZ),
)

USERS = _table(
    ("user_id", T.StringType()),
    ("email", T.StringType()),
    ("role", T.StringType()),
    ("department", T.StringType()),
    ("first_name", T.StringType()),
    ("last_name", T.StringType()),
    ("created_at", _NTZ),
    ("updated_at", _NTZ),
)

ENERGY = _table(
    ("record_id", T.StringType()),
    ("building_id", T.StringType()),
    ("date_time", _NTZ),
    ("source", T.StringType()),
    ("consumption_kwh", KWH),
    ("co2e_emitted", ENERGY_CO2E),
    ("created_at", _NTZ),
)

TRIPS = _table(
    ("trip_id", T.StringType()),
    ("user_id", T.StringType()),
    ("date", T.DateType()),
    ("mode", T.StringType()),
    ("distance_km", KM),
    ("co2e_emitted", TRIP_CO2E),
    ("created_at", _NTZ),
)

INITIATIVES = _table(
    ("initiative_id", T.StringType()),
    ("name", T.StringType()),
    ("description", T.StringType()),
    ("target_reduction_tco2e", REDUCTION),
    ("actual_reduction_tco2e", REDUCTION),
    ("status", T.StringType()),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
    ("created_by", T.StringType()),
    ("created_at", _NTZ),
    ("updated_at", _NTZ),
)

SCHEMAS = {
    "buildings": BUILDINGS,
    "users": USERS,
    "energy_consumption": ENERGY,
    "transportation_log": TRIPS,
    "initiatives": INITIATIVES,
}

# Time column that decides the month partition of a fact table.
FACT_TIME = {"energy_consumption": "date_time", "transportation_log": "date"}

KEY_COLUMNS = frozenset(
    {"building_id", "user_id", "record_id", "trip_id", "initiative_id", "created_by"}
)


@dataclass
class Ledger:
    """The five tables a report may read."""

    buildings: DataFrame
    users: DataFrame
    energy: DataFrame
    trips: DataFrame
    initiatives: DataFrame


def check_schema(df: DataFrame, table: str) -> DataFrame:
    """Fail early when a column is missing or has the wrong type.

    Keys may have any type (UUID strings, bigints); columns beyond the model are let through.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in SCHEMAS[table].fields:
        if field.name not in found:
            problems.append(f"{field.name} is missing")
        elif field.name not in KEY_COLUMNS and found[field.name] != field.dataType:
            problems.append(
                f"{field.name} is {found[field.name].simpleString()},"
                f" not {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"{table}: " + "; ".join(problems))
    return df
