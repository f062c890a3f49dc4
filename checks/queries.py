"""Registered queries over the bound tables: one entry per report or job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.operators import predicates
from cinderbook.params import DateRange, Page
from cinderbook.plans import buildings, daily, energy, initiatives, overview, transport
from cinderbook.sources.binding import AS_OF, ledger

YEAR = DateRange.last_days(AS_OF, 365)
QUARTER = DateRange.last_days(AS_OF, 90)
MONTH = DateRange.last_days(AS_OF, 30)

# Key columns that make the listing of readings total (line numbers repeat in the given data).
READING_TIES = ("record_id", "building_name", "consumption_kwh", "source")

TRIP_COLUMNS = ("trip_id", "date", "mode", "distance_km", "co2e_emitted", "created_at")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, for the comparison only."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            columns.append(f"CAST(`{field.name}` AS DOUBLE) AS `{field.name}`")
        else:
            columns.append(f"`{field.name}`")
    return df.selectExpr(*columns)


def query(name: str):
    """Register a function of the ledger."""

    def keep(function):
        REGISTRY[name] = lambda spark, sf_dir: comparable(function(ledger(spark, sf_dir)))
        return function

    return keep


def job(name: str):
    """Register a function of (spark, sf_dir)."""

    def keep(function):
        REGISTRY[name] = lambda spark, sf_dir: comparable(function(spark, sf_dir))
        return function

    return keep


# --- overview -------------------------------------------------------------------------------
query("campus_overview")(lambda t: overview.campus_overview(t, AS_OF))
query("scope_breakdown")(lambda t: overview.scope_breakdown(t.energy, t.trips, AS_OF))
query("scope_breakdown_range")(lambda t: overview.scope_breakdown_range(t.energy, t.trips, YEAR))
query("monthly_trend_by_scope")(lambda t: overview.monthly_trend_by_scope(t.energy, t.trips, YEAR))
query("carbon_footprint_summary")(
    lambda t: overview.carbon_footprint_summary(t.buildings, t.energy, t.trips, YEAR)
)

# --- buildings ------------------------------------------------------------------------------
query("building_performance")(lambda t: buildings.building_performance(t.buildings, t.energy))
query("building_performance_top")(lambda t: buildings.building_performance(t.buildings, t.energy, limit=10))
query("top_buildings_quarter")(lambda t: buildings.top_buildings_quarter(t.buildings, t.energy, AS_OF))
query("top_buildings")(lambda t: buildings.top_buildings(t.buildings, t.energy, MONTH))
query("top_buildings_range")(lambda t: buildings.top_buildings_range(t.buildings, t.energy, QUARTER))
query("buildings_vs_campus_average")(
    lambda t: buildings.buildings_vs_campus_average(t.buildings, t.energy, QUARTER)
)
query("building_breakdown_range")(lambda t: buildings.building_breakdown_range(t.buildings, t.energy, YEAR))
query("building_efficiency")(lambda t: buildings.building_efficiency(t.buildings, t.energy, AS_OF))
query("building_performance_ranked")(
    lambda t: buildings.building_performance_ranked(t.buildings, t.energy, AS_OF)
)
query("building_performance_lowest_first")(
    lambda t: buildings.building_performance_ranked(t.buildings, t.energy, AS_OF, highest_first=False)
)
query("building_type_summary")(lambda t: buildings.building_type_summary(t.buildings, t.energy, AS_OF))
query("building_type_summary_dedup")(
    lambda t: buildings.building_type_summary_dedup(t.buildings, t.energy, AS_OF)
)
query("building_recent")(lambda t: buildings.building_recent(t.buildings, t.energy, AS_OF))
query("building_source_mix")(lambda t: buildings.building_source_mix(t.energy, AS_OF))
query("building_listing")(
    lambda t: buildings.building_listing(t.buildings, Page(2, 5)).drop("location_gps")
)

query("building_listing_info")(lambda t: buildings.building_listing_info(t.buildings, Page(2, 5)))

# The same ranks and percentiles by the range-partitioned method, as beyond one task's reach.
query("building_efficiency_partitioned")(
    lambda t: buildings.building_efficiency(t.buildings, t.energy, AS_OF, partitioned=True)
)
query("building_performance_partitioned")(
    lambda t: buildings.building_performance_ranked(t.buildings, t.energy, AS_OF, partitioned=True)
)

# --- energy ---------------------------------------------------------------------------------
query("energy_source_breakdown")(lambda t: energy.energy_source_breakdown(t.energy, YEAR))
query("monthly_energy_trend")(lambda t: energy.monthly_energy_trend(t.energy, AS_OF))
query("monthly_building_mom")(lambda t: energy.monthly_building_mom(t.buildings, t.energy, AS_OF))
query("energy_summary_by_building")(
    lambda t: energy.energy_summary_by_building(t.buildings, t.energy, MONTH, AS_OF)
)
query("energy_summary_public")(
    lambda t: energy.energy_summary_by_building(t.buildings, t.energy, YEAR, AS_OF, source="gas", role=None)
)
for _period in energy.PERIODS:
    query(f"energy_trends_{_period}")(
        lambda t, period=_period: energy.energy_trends(t.energy, MONTH, AS_OF, period=period)
    )
query("peak_hours")(lambda t: energy.peak_hours(t.buildings, t.energy, AS_OF))
query("daily_energy_activity")(lambda t: energy.daily_energy_activity(t.energy, QUARTER))
query("energy_listing")(
    lambda t: energy.energy_listing(
        t.buildings, t.energy, AS_OF, Page(3, 50), role="admin", tie_break=READING_TIES
    )
)
query("energy_listing_public")(
    lambda t: energy.energy_listing(t.buildings, t.energy, AS_OF, Page(1, 50), tie_break=READING_TIES)
)
DEEP_TIES = ("record_id", "building_id", "consumption_kwh", "source")
query("energy_listing_deep")(
    lambda t: energy.energy_listing(t.buildings, t.energy, AS_OF, Page(1001, 50), role="admin", tie_break=DEEP_TIES)
)
query("energy_listing_after")(
    lambda t: energy.energy_listing_after(t.buildings, t.energy, AS_OF, (dt.datetime(1999, 1, 1, 5), 0), 100, role="admin")
)
query("trip_listing_admin_deep")(lambda t: transport.trip_listing_admin(t.users, t.trips, Page(211, 50)))
query("energy_listing_info")(
    lambda t: energy.energy_listing_info(t.buildings, t.energy, AS_OF, Page(3, 50), role="admin")
)

# --- transport ------------------------------------------------------------------------------
query("transport_mode_breakdown")(lambda t: transport.transport_mode_breakdown(t.trips, YEAR))
query("user_footprint")(lambda t: transport.user_footprint(t.users, t.trips))
query("user_transport_patterns")(lambda t: transport.user_transport_patterns(t.users, t.trips, AS_OF))
query("user_transport_patterns_partitioned")(
    lambda t: transport.user_transport_patterns(t.users, t.trips, AS_OF, partitioned=True)
)
query("user_recent_trip_stats")(lambda t: transport.user_recent_trip_stats(t.users, t.trips, AS_OF))
query("user_transport_patterns_range")(
    lambda t: transport.user_transport_patterns_range(t.users, t.trips, QUARTER)
)
query("user_transport_patterns_department")(
    lambda t: transport.user_transport_patterns_range(t.users, t.trips, YEAR, department="MACHINERY")
)
query("department_summary")(lambda t: transport.department_summary(t.users, t.trips, QUARTER))
query("user_activity_summary")(lambda t: transport.user_activity_summary(t.users, t.trips, MONTH))
query("personal_footprint")(lambda t: transport.personal_footprint(t.users, t.trips, AS_OF))
query("personal_footprint_year")(
    lambda t: transport.personal_footprint(t.users, t.trips, AS_OF, period="1year")
)
query("user_vs_campus_average")(lambda t: transport.user_vs_campus_average(t.users, t.trips, AS_OF))
query("personal_monthly_trend")(lambda t: transport.personal_monthly_trend(t.trips, AS_OF))
query("personal_mode_breakdown")(lambda t: transport.personal_mode_breakdown(t.trips, AS_OF))
query("personal_weekly_trend")(lambda t: transport.personal_weekly_trend(t.trips, AS_OF))
query("trip_listing")(lambda t: transport.trip_listing_per_user(t.trips, Page(1, 5)))
query("trip_listing_admin")(lambda t: transport.trip_listing_admin(t.users, t.trips, Page(2, 50)))
query("trip_listing_filtered")(
    lambda t: transport.trip_listing_admin(
        t.users, t.trips, Page(1, 50), mode="train", department="BUILDING", start=YEAR.start, end=YEAR.end
    )
)
query("trip_listing_after")(
    lambda t: transport.trip_listing_admin_after(
        t.users, t.trips, (MONTH.start, F.lit(MONTH.start).cast("timestamp_ntz"), 0)
    )
)
query("own_trips")(lambda t: predicates.own_trips(t.trips, "user", 1).select("user_id", *TRIP_COLUMNS))
query("trip_listing_info")(lambda t: transport.trip_listing_info(t.users, t.trips, Page(2, 50)))
query("trip_listing_info_user")(lambda t: transport.trip_listing_info(t.users, t.trips, Page(1, 5), user_id=1))
query("user_directory")(lambda t: transport.user_directory(t.users))

# --- initiatives ----------------------------------------------------------------------------
query("initiative_effectiveness")(
    lambda t: initiatives.initiative_effectiveness(t.initiatives, t.users, AS_OF)
)
query("initiative_effectiveness_summary")(
    lambda t: initiatives.initiative_effectiveness_summary(t.initiatives)
)
query("initiative_progress")(lambda t: initiatives.initiative_progress(t.initiatives))
query("initiative_overview")(lambda t: initiatives.initiative_overview(t.initiatives))
query("top_initiatives")(lambda t: initiatives.top_initiatives(t.initiatives))
query("initiative_status_breakdown")(lambda t: initiatives.initiative_status_breakdown(t.initiatives))
query("active_initiatives_top")(lambda t: initiatives.active_initiatives_top(t.initiatives))
query("initiative_listing")(
    lambda t: initiatives.initiative_listing(t.initiatives, t.users, Page(2, 20), role="admin")
)
query("initiative_listing_public")(
    lambda t: initiatives.initiative_rows(t.initiatives, t.users, status="active")
)
query("initiative_listing_info")(
    lambda t: initiatives.initiative_listing_info(t.initiatives, Page(1, 20), status="completed")
)

# --- one day --------------------------------------------------------------------------------
query("daily_dashboard")(lambda t: daily.daily_dashboard(t.energy, t.trips, AS_OF))
query("daily_summary")(lambda t: daily.daily_summary(t.energy, t.trips, AS_OF))
query("realtime_snapshot")(lambda t: daily.realtime_snapshot(t.energy, t.trips, AS_OF))
