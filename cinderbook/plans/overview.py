"""Organisation-wide reports: overview, scopes, trends, executive summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbook.functions.exprs import month_of, or_zero, rounded, tonnes
from cinderbook.operators.predicates import between_days
from cinderbook.operators.ranking import share_of_total
from cinderbook.operators.totals import (
    co2e_sum,
    co2e_totals,
    energy_totals,
    one_row,
    roll_up,
    row_count,
    trip_totals,
)
from cinderbook.params import DateRange, months_before
from cinderbook.plans import buildings as building_plans
from cinderbook.plans import energy as energy_plans
from cinderbook.plans import initiatives as initiative_plans
from cinderbook.plans import transport as transport_plans
from cinderbook.schemas import Ledger

# Scope labels.
ENERGY_SCOPE = "Scope 1 & 2 (Energy)"
TRIP_SCOPE = "Scope 3 (Transportation)"


def campus_overview(ledger: Ledger, as_of: dt.date | str) -> DataFrame:
    """One row: buildings, a year of emissions per scope, running initiatives."""
    year_ago = months_before(as_of, 12)
    energy = between_days(ledger.energy, "date_time", start=year_ago)
    trips = between_days(ledger.trips, "date", start=year_ago)
    parts = one_row(
        ledger.buildings.sparkSession,
        buildings=ledger.buildings.agg(row_count().alias("n")),
        energy=energy.agg(or_zero(co2e_sum(energy)).alias("co2e")),
        trips=trips.agg(or_zero(co2e_sum(trips)).alias("co2e")),
        initiatives=ledger.initiatives.agg(F.count_if(F.col("status") == "active").alias("n")),
    )
    return parts.select(
        F.col("buildings.n").alias("total_buildings"),
        F.col("energy.co2e").alias("annual_energy_co2e"),
        F.col("trips.co2e").alias("annual_transport_co2e"),
        (F.col("energy.co2e") + F.col("trips.co2e")).alias("total_annual_co2e"),
        F.col("initiatives.n").alias("active_initiatives"),
    )


def _scope_row(fact: DataFrame) -> DataFrame:
    return fact.agg(co2e_sum(fact).alias("co2e"), row_count().alias("record_count"))


def _scope_rows_of(energy: DataFrame, trips: DataFrame) -> DataFrame:
    """The two scopes from the single total rows of the facts.

    A scope without rows keeps a NULL total and a NULL share.
    """
    labelled = [
        row.select(F.lit(scope).alias("emission_scope"), F.lit(source).alias("data_source"), "co2e", "record_count")
        for row, scope, source in ((energy, ENERGY_SCOPE, "energy"), (trips, TRIP_SCOPE, "transportation"))
    ]
    return labelled[0].unionByName(labelled[1]).select(
        "emission_scope",
        F.round("co2e", 2).alias("total_co2e_kg"),
        rounded(share_of_total(F.col("co2e")), 1).alias("percentage"),
        "record_count",
        "data_source",
    ).orderBy(F.col("total_co2e_kg").desc_nulls_first(), "emission_scope")


def scope_breakdown(energy: DataFrame, trips: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Emissions, share and row count per scope over the last year."""
    start = months_before(as_of, 12)
    energy, trips = between_days(energy, "date_time", start=start), between_days(trips, "date", start=start)
    return _scope_rows_of(_scope_row(energy), _scope_row(trips)).drop("data_source")


def scope_breakdown_range(energy: DataFrame, trips: DataFrame, days: DateRange) -> DataFrame:
    energy = between_days(energy, "date_time", days.start, days.end)
    trips = between_days(trips, "date", days.start, days.end)
    return _scope_rows_of(_scope_row(energy), _scope_row(trips))


def monthly_trend_by_scope(energy: DataFrame, trips: DataFrame, days: DateRange) -> DataFrame:
    energy = between_days(energy, "date_time", days.start, days.end)
    trips = between_days(trips, "date", days.start, days.end)
    return _month_rows_of(
        co2e_totals(energy, month_of(F.col("date_time")).alias("month")),
        co2e_totals(trips, month_of(F.col("date")).alias("month")),
    )


def _month_rows_of(energy: DataFrame, trips: DataFrame) -> DataFrame:
    """Both facts' totals per month below each other."""
    parts = [
        fact.select("month", F.col("co2e").cast("decimal(24,4)").alias("monthly_co2e"), F.lit(source).alias("source"))
        for fact, source in ((energy, "energy"), (trips, "transportation"))
    ]
    return parts[0].unionByName(parts[1]).orderBy("month", "source")


def carbon_footprint_summary(
    buildings: DataFrame, energy: DataFrame, trips: DataFrame, days: DateRange
) -> DataFrame:
    """The executive summary as one row."""
    energy = between_days(energy, "date_time", days.start, days.end)
    trips = between_days(trips, "date", days.start, days.end)
    return _summary_of(buildings, co2e_totals(energy, "building_id"), _scope_row(trips), days)


def _summary_of(buildings: DataFrame, per_building: DataFrame, trips: DataFrame, days: DateRange) -> DataFrame:
    """From the energy total per building and the trip total.

    Scope totals include readings of unknown buildings; the building count and the top emitter
    do not.
    """
    known = buildings.select("building_id", F.col("name").alias("building_name"))
    ranked = per_building.join(known, "building_id", "left").withColumn("rounded", F.round("co2e", 2))
    # The top emitter has the largest rounded total; of several, the smallest key.
    is_known = F.col("building_name").isNotNull()
    by_total = ranked.groupBy("rounded").agg(
        F.sum("co2e").alias("co2e"),
        F.count("building_name").alias("known"),
        F.min_by("building_name", F.when(is_known, F.col("building_id"))).alias("first_name"),
    )
    energy_side = by_total.agg(
        F.round(F.sum("co2e").cast("decimal(24,4)"), 2).alias("co2e"),
        F.sum("known").alias("known"),
        F.max_by("first_name", F.when(F.col("known") > 0, F.col("rounded"))).alias("top_name"),
    )
    trip_side = trips.select(F.round("co2e", 2).alias("co2e"))
    parts = one_row(buildings.sparkSession, energy=energy_side, trips=trip_side)
    energy_co2e = or_zero(F.col("energy.co2e"))
    trip_co2e = or_zero(F.col("trips.co2e"))
    return parts.select(
        F.lit(days.start).alias("start_date"),
        F.lit(days.end).alias("end_date"),
        (energy_co2e + trip_co2e).alias("total_co2e_kg"),
        tonnes(energy_co2e + trip_co2e).alias("total_co2e_tonnes"),
        energy_co2e.alias("energy_co2e_kg"),
        trip_co2e.alias("transport_co2e_kg"),
        F.coalesce("energy.top_name", F.lit("N/A")).alias("top_emitting_building"),
        or_zero(F.col("energy.known")).alias("total_buildings"),
        F.lit(days.period_days).cast("bigint").alias("report_period_days"),
    )


def carbon_footprint(ledger: Ledger, days: DateRange, limit: int | None = None) -> dict[str, DataFrame]:
    """Every section of the carbon footprint report.

    Readings are totalled by month, building and source, trips by month and mode; all sections roll
    these two small tables up.  In one query over several sections Spark reads each fact once and
    reuses the totals.
    """
    energy = between_days(ledger.energy, "date_time", days.start, days.end)
    trips = between_days(ledger.trips, "date", days.start, days.end)
    by_energy = energy_totals(energy, month_of(F.col("date_time")).alias("month"), "building_id", "source")
    by_trip = trip_totals(trips, month_of(F.col("date")).alias("month"), "mode")
    energy_row = roll_up(by_energy).withColumnRenamed("records", "record_count")
    trip_row = roll_up(by_trip).withColumnRenamed("trips", "record_count")
    energy_row, trip_row = (row.withColumn("record_count", or_zero(F.col("record_count"))) for row in (energy_row, trip_row))
    per_building = roll_up(by_energy, "building_id")
    return {
        "summary": _summary_of(ledger.buildings, per_building, trip_row, days),
        "scopes": _scope_rows_of(energy_row, trip_row),
        "buildings": building_plans.building_rows_of(ledger.buildings, per_building, limit),
        "monthly_trend": _month_rows_of(roll_up(by_energy, "month"), roll_up(by_trip, "month")),
        "energy_sources": energy_plans.source_rows_of(roll_up(by_energy, "source")),
        "transport_modes": transport_plans.mode_rows_of(roll_up(by_trip, "mode")),
    }


def public_dashboard(ledger: Ledger, as_of: dt.date | str) -> dict[str, DataFrame]:
    return {
        "overview": campus_overview(ledger, as_of),
        "scopes": scope_breakdown(ledger.energy, ledger.trips, as_of),
        "active_initiatives": initiative_plans.active_initiatives_top(ledger.initiatives),
        "monthly_trend": energy_plans.monthly_energy_trend(ledger.energy, as_of),
    }


def admin_dashboard(ledger: Ledger, days: DateRange) -> dict[str, DataFrame]:
    return {
        "top_buildings": building_plans.top_buildings(ledger.buildings, ledger.energy, days, limit=5),
        "daily": energy_plans.daily_energy_activity(ledger.energy, days),
        "user_activity": transport_plans.user_activity_summary(ledger.users, ledger.trips, days),
        "initiatives": initiative_plans.initiative_progress(ledger.initiatives),
        "building_performance": building_plans.building_performance(ledger.buildings, ledger.energy, limit=10),
    }
