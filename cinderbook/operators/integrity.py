"""Table-level constraints: keys, references, value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.schemas import ENERGY_SOURCES, ROLES, STATUSES, TRIP_MODES, Ledger


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    """Values that should be unique but occur more than once, with their number of rows."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Referenced keys without a parent row, with the number of child rows.

    Children are counted per key before the anti join, so a key shared by most of them is one row.
    """
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(parent_key or child_key).alias(child_key))
    return keys.join(known, child_key, "left_anti")


def _checks() -> dict[str, dict[str, Column]]:
    """Value rules per table; as in SQL, a rule that is NULL for a row holds."""
    c = F.col
    start, end = c("start_date"), c("end_date")
    return {
        "buildings": {"sq_footage > 0": c("sq_footage") > 0},
        "users": {"role in set": c("role").isin(*ROLES)},
        "energy_consumption": {
            "source in set": c("source").isin(*ENERGY_SOURCES),
            "consumption_kwh >= 0": c("consumption_kwh") >= 0,
        },
        "transportation_log": {
            "mode in set": c("mode").isin(*TRIP_MODES),
            "distance_km >= 0": c("distance_km") >= 0,
        },
        "initiatives": {
            "target_reduction_tco2e >= 0": c("target_reduction_tco2e") >= 0,
            "actual_reduction_tco2e >= 0": c("actual_reduction_tco2e") >= 0,
            "status in set": c("status").isin(*STATUSES),
            "end_date >= start_date": start.isNull() | end.isNull() | (end >= start),
        },
    }


# Columns that must hold a value, unique columns and references, per table.
REQUIRED = {
    "buildings": ("building_id", "name", "sq_footage", "primary_use"),
    "users": ("user_id", "email", "role", "first_name", "last_name"),
    "energy_consumption": ("record_id", "building_id", "date_time", "source", "consumption_kwh"),
    "transportation_log": ("trip_id", "user_id", "date", "mode", "distance_km"),
    "initiatives": ("initiative_id", "name", "status"),
}
UNIQUE = {
    "buildings": ("building_id", "name"),
    "users": ("user_id", "email"),
    "energy_consumption": ("record_id",),
    "transportation_log": ("trip_id",),
    "initiatives": ("initiative_id",),
}
REFERENCES = {
    "energy_consumption": ("building_id", "buildings", "building_id"),
    "transportation_log": ("user_id", "users", "user_id"),
    "initiatives": ("created_by", "users", "user_id"),
}


def table_violations(ledger: Ledger) -> DataFrame:
    """(table_name, rule, violations) for every constraint of the model.

    Value and NOT NULL rules of a table are counted in one scan.  A unique rule counts the rows
    beyond the first of each value, a reference rule the rows without a parent.
    """
    tables = {
        "buildings": ledger.buildings,
        "users": ledger.users,
        "energy_consumption": ledger.energy,
        "transportation_log": ledger.trips,
        "initiatives": ledger.initiatives,
    }
    report = None
    checks = _checks()
    for name, df in tables.items():
        counts = {f"{column} not null": F.count_if(F.col(column).isNull()) for column in REQUIRED[name]}
        counts |= {rule: F.count_if(~holds) for rule, holds in checks[name].items()}
        rows = [F.struct(F.lit(rule).alias("rule"), n.alias("violations")) for rule, n in counts.items()]
        parts = [df.agg(F.array(*rows).alias("found")).select(F.inline("found"))]
        for column in UNIQUE[name]:
            extra = F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))
            repeated = duplicates(df.filter(F.col(column).isNotNull()), column)
            parts.append(repeated.agg(extra.alias("violations")).select(F.lit(f"{column} unique").alias("rule"), "violations"))
        if name in REFERENCES:
            column, parent, parent_key = REFERENCES[name]
            lost = orphans(df, tables[parent], column, parent_key).agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")
            )
            parts.append(lost.select(F.lit(f"{column} references {parent}").alias("rule"), "violations"))
        for part in parts:
            part = part.select(F.lit(name).alias("table_name"), "rule", "violations")
            report = part if report is None else report.unionByName(part)
    return report
