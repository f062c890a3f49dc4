"""Row rules for submitted data.

Submissions arrive as text.  Each `check_*` function returns the submission with typed columns
and an `errors` array; `accepted` and `rejected` split it.  A rule that evaluates to NULL counts
as broken, so required fields need no separate rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.functions.exprs import point
from cinderbook.schemas import ENERGY_SOURCES, KM, KWH, REDUCTION, STATUSES, TRIP_MODES

# Patterns of text fields.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)*\.[A-Za-z]{2,}$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+$"


def iso_timestamp(text: Column) -> Column:
    """NULL unless the text is an ISO date or time; a zone offset is converted to UTC."""
    local = text.try_cast("timestamp_ntz")
    instant = text.try_cast("timestamp").cast("timestamp_ntz")
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)
    has_zone = text.contains(":") & text.rlike(ZONED)
    return F.when(text.rlike(ISO_TIME), F.when(has_zone, in_utc).otherwise(local))


def iso_date(text: Column) -> Column:
    return iso_timestamp(text).cast("date")


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _optional(text: Column, rule: Column) -> Column:
    return text.isNull() | rule


def _length(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def with_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the messages of all broken rules."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)) for text, holds in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def _profile_rules() -> dict[str, Column]:
    return {
        "first_name must have 2 to 50 characters": _length(F.col("first_name"), 2, 50),
        "last_name must have 2 to 50 characters": _length(F.col("last_name"), 2, 50),
        "department must have at most 100 characters": _optional(
            F.col("department"), F.length("department") <= 100
        ),
    }


def check_profiles(df: DataFrame) -> DataFrame:
    """Names and department, trimmed."""
    return with_errors(df.withColumns({c: F.trim(c) for c in ("first_name", "last_name", "department")}), _profile_rules())


def check_users(df: DataFrame) -> DataFrame:
    """Profiles with an address, which is lower-cased."""
    tidy = df.withColumns({c: F.trim(c) for c in ("first_name", "last_name", "department")})
    tidy = tidy.withColumn("email", F.lower(F.trim("email")))
    return with_errors(tidy, {"email": F.col("email").rlike(EMAIL)} | _profile_rules())


def _checked(parsed: DataFrame, rules: dict[str, Column], typed: dict[str, Column]) -> DataFrame:
    """Errors and typed columns from a frame whose `_` columns hold parsed values.

    Parsing is a step of its own, so that a value is parsed once for its rule and its column.
    """
    scratch = [c for c in parsed.columns if c.startswith("_")]
    return with_errors(parsed, rules).withColumns(typed).drop(*scratch)


def check_trips(df: DataFrame) -> DataFrame:
    km = F.col("distance_km")
    parsed = df.withColumns({"_date": iso_date(F.col("date")), "_km": _number(km)})
    rules = {
        "date must be an ISO date": F.col("_date").isNotNull(),
        "mode is unknown": F.col("mode").isin(*TRIP_MODES),
        "distance_km must be 0 to 10000": F.col("_km").between(0, 10_000),
    }
    return _checked(parsed, rules, {"date": F.col("_date"), "distance_km": km.try_cast(KM)})


def check_readings(df: DataFrame, key_pattern: str = UUID) -> DataFrame:
    kwh = F.col("consumption_kwh")
    parsed = df.withColumns({"_time": iso_timestamp(F.col("date_time")), "_kwh": _number(kwh)})
    rules = {
        "building_id is malformed": F.col("building_id").cast("string").rlike(key_pattern),
        "date_time must be an ISO time": F.col("_time").isNotNull(),
        "source is unknown": F.col("source").isin(*ENERGY_SOURCES),
        "consumption_kwh must be 0 to 1000000": F.col("_kwh").between(0, 1_000_000),
    }
    return _checked(parsed, rules, {"date_time": F.col("_time"), "consumption_kwh": kwh.try_cast(KWH)})


def check_initiatives(df: DataFrame) -> DataFrame:
    target, status = F.col("target_reduction_tco2e"), F.col("status")
    start, end = F.col("start_date"), F.col("end_date")
    parsed = df.withColumns(
        {
            "name": F.trim("name"),
            "description": F.trim("description"),
            "_target": _number(target),
            "_start": iso_date(start),
            "_end": iso_date(end),
        }
    )
    rules = {
        "name must have 3 to 200 characters": _length(F.col("name"), 3, 200),
        "description must have at most 1000 characters": _optional(
            F.col("description"), F.length("description") <= 1000
        ),
        "target_reduction_tco2e must not be negative": _optional(target, F.col("_target") >= 0),
        "status is unknown": _optional(status, status.isin(*STATUSES)),
        "start_date must be an ISO date": _optional(start, F.col("_start").isNotNull()),
        "end_date must be an ISO date": _optional(end, F.col("_end").isNotNull()),
        "end_date must not be before start_date": F.coalesce(F.col("_end") >= F.col("_start"), F.lit(True)),
    }
    typed = {
        "target_reduction_tco2e": target.try_cast(REDUCTION),
        "start_date": F.col("_start"),
        "end_date": F.col("_end"),
    }
    return _checked(parsed, rules, typed)


def check_buildings(df: DataFrame) -> DataFrame:
    area, gps = F.col("sq_footage"), F.col("location_gps")
    parsed = df.withColumns(
        {
            "name": F.trim("name"),
            "primary_use": F.trim("primary_use"),
            "_area": F.when(area.rlike(WHOLE), area.try_cast("bigint")),
            "_gps": point(gps),
        }
    )
    rules = {
        "name must have 2 to 100 characters": _length(F.col("name"), 2, 100),
        "sq_footage must be a whole number from 1 to 10000000": F.col("_area").between(1, 10_000_000),
        "primary_use must have 2 to 50 characters": _length(F.col("primary_use"), 2, 50),
        "location_gps must be POINT(x y)": _optional(gps, F.col("_gps").isNotNull()),
    }
    return _checked(parsed, rules, {"sq_footage": area.try_cast("int"), "location_gps": F.col("_gps")})


def check_progress(df: DataFrame) -> DataFrame:
    """Progress patches: any of the two fields, at least one."""
    actual, status = F.col("actual_reduction_tco2e"), F.col("status")
    rules = {
        "actual_reduction_tco2e must be a non-negative number": _optional(actual, _number(actual) >= 0),
        "status is unknown": _optional(status, status.isin(*STATUSES)),
        "nothing to change": actual.isNotNull() | status.isNotNull(),
    }
    return _checked(df, rules, {"actual_reduction_tco2e": actual.try_cast(REDUCTION)})


def check_typed(check: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """The check of submitted text over rows that have types already: the rows with their errors, texts trimmed."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = {c: F.col(c).cast("string") for c, kind in kinds.items() if not isinstance(kind, (T.StringType, T.StructType))}
    for name, kind in kinds.items():
        if isinstance(kind, T.StructType):
            text[name] = F.concat(F.lit("POINT("), F.col(f"{name}.x"), F.lit(" "), F.col(f"{name}.y"), F.lit(")"))
    checked = check(df.withColumns(text))
    return checked.withColumns({c: F.col(c).cast(kinds[c]) for c in text if checked.schema[c].dataType.simpleString() != kinds[c].simpleString()})


def check_initiative_updates(df: DataFrame) -> DataFrame:
    """A whole initiative as it is to be: the rules of a new one, and those of its progress; the status is needed."""
    actual = F.col("actual_reduction_tco2e")
    checked = check_initiatives(df)
    more = with_errors(checked.withColumnRenamed("errors", "_before"), {
        "actual_reduction_tco2e must be a non-negative number": _optional(actual, _number(actual) >= 0),
        "status is missing": F.col("status").isNotNull(),
    })
    return more.withColumns({"errors": F.concat("_before", "errors"), "actual_reduction_tco2e": actual.try_cast(REDUCTION)}).drop("_before")
