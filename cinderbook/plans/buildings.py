"""Reports per building: totals, comparisons, efficiency, types."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.functions.exprs import (
    mean,
    or_zero,
    quartile_rating,
    rank_percentile_rating,
    ratio,
    rounded,
)
from cinderbook.operators.paging import numbered, page_info, page_of, top
from cinderbook.operators.predicates import between_days, equal_to, where
from cinderbook.operators.ranking import with_global_rank, with_percentiles
from cinderbook.operators.totals import co2e_totals, energy_totals, exact_sum, row_count
from cinderbook.params import DateRange, Page, days_before, months_before


def _described(buildings: DataFrame) -> DataFrame:
    return buildings.select("building_id", F.col("name").alias("building_name"), "primary_use", "sq_footage")


def building_performance(buildings: DataFrame, energy: DataFrame, limit: int | None = None) -> DataFrame:
    """All-time totals of every building, also those without readings; optionally the top emitters."""
    totals = energy_totals(energy, "building_id")
    rows = buildings.join(totals, "building_id", "left").select(
        "building_id",
        "name",
        "sq_footage",
        "primary_use",
        or_zero(F.col("co2e")).alias("total_co2e"),
        or_zero(F.col("kwh")).alias("total_consumption_kwh"),
        F.coalesce(ratio(F.col("co2e"), F.col("sq_footage")), F.lit(0.0)).alias("co2e_per_sqft"),
    )
    if limit is None:
        return rows
    return top(rows, [F.col("total_co2e").desc_nulls_first(), F.col("building_id")], limit)


def _emitters(buildings: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of buildings with readings, rounded for the report; keeps the key for tie-breaks."""
    return totals.join(_described(buildings), "building_id").select(
        "building_id",
        "building_name",
        "primary_use",
        "sq_footage",
        F.round("co2e", 2).alias("total_co2e_kg"),
        rounded(ratio(F.col("co2e"), F.col("sq_footage")), 4).alias("co2e_per_sqft"),
        F.col("records").alias("total_records"),
        rounded(mean(F.col("kwh"), F.col("records")), 2).alias("avg_consumption_kwh"),
        F.round("kwh", 2).alias("total_consumption_kwh"),
    )


def _largest_first() -> list[Column]:
    """By the rounded total, as printed; the key settles ties."""
    return [F.col("total_co2e_kg").desc_nulls_first(), F.col("building_id")]


_SHORT = ("building_name", "primary_use", "sq_footage", "total_co2e_kg", "co2e_per_sqft", "total_records")


def top_buildings_quarter(
    buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, limit: int = 5
) -> DataFrame:
    """The largest emitters of the last three months."""
    recent = between_days(energy, "date_time", start=months_before(as_of, 3))
    return building_rows_of(buildings, energy_totals(recent, "building_id"), limit)


def top_buildings(buildings: DataFrame, energy: DataFrame, days: DateRange, limit: int = 5) -> DataFrame:
    """The largest emitters of a date range."""
    recent = between_days(energy, "date_time", days.start, days.end)
    return building_rows_of(buildings, energy_totals(recent, "building_id"), limit)


def top_buildings_range(
    buildings: DataFrame, energy: DataFrame, days: DateRange, limit: int = 10
) -> DataFrame:
    """The largest emitters of a date range with consumption and position."""
    recent = between_days(energy, "date_time", days.start, days.end)
    found = _emitters(buildings, energy_totals(recent, "building_id"))
    return numbered(top(found, _largest_first(), limit), _largest_first()).drop("building_id")


def building_breakdown_range(buildings: DataFrame, energy: DataFrame, days: DateRange) -> DataFrame:
    """Every building with readings in the range."""
    recent = between_days(energy, "date_time", days.start, days.end)
    return building_rows_of(buildings, energy_totals(recent, "building_id"))


def building_rows_of(buildings: DataFrame, totals: DataFrame, limit: int | None = None) -> DataFrame:
    """Report rows from totals per building, largest first."""
    found = _emitters(buildings, totals)
    rows = found.orderBy(*_largest_first()) if limit is None else top(found, _largest_first(), limit)
    return rows.select(*_SHORT)


def buildings_vs_campus_average(buildings: DataFrame, energy: DataFrame, days: DateRange) -> DataFrame:
    """Each building's total against the mean of all building totals.

    The mean is a scalar subquery over the very same aggregation, so Spark reuses its shuffle
    and scans the readings once.
    """
    recent = between_days(energy, "date_time", days.start, days.end)
    totals = co2e_totals(recent, "building_id").join(_described(buildings), "building_id")
    intensity = ratio(F.col("co2e"), F.col("sq_footage"))
    # Doubles are added in decimal, so that the mean does not depend on the order of the buildings.
    exact_intensity = intensity.cast("decimal(28,16)")
    campus = totals.agg(
        F.struct(
            mean(F.sum("co2e"), F.count("co2e")).alias("co2e"),
            mean(F.sum(exact_intensity), F.count(exact_intensity)).alias("intensity"),
        ).alias("campus")
    )
    average = F.col("campus.co2e")
    total = F.round("co2e", 2)
    versus = (total.cast("double") / average - 1) * 100
    return (
        totals.withColumn("campus", campus.scalar())
        .select(
            "building_id",
            "building_name",
            total.alias("total_co2e_kg"),
            rounded(average, 2).alias("campus_avg_co2e"),
            rounded(F.col("campus.intensity"), 4).alias("campus_avg_intensity"),
            F.when(average > 0, rounded(versus, 1)).alias("vs_average_percent"),
        )
        .orderBy(*_largest_first())
    )


def building_efficiency(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    partitioned: bool = False,
) -> DataFrame:
    """Mean, spread, intensity, rank and quartile rating over the last month's readings.

    The averages are per reading.  There is one row per building; `partitioned` ranks them
    without bringing all of them into one task.
    """
    kwh = F.col("consumption_kwh")
    stats = between_days(energy, "date_time", start=months_before(as_of, 1)).groupBy("building_id").agg(
        row_count().alias("records"),
        exact_sum(energy, "consumption_kwh").alias("kwh"),
        exact_sum(energy, "co2e_emitted").alias("co2e"),
        F.stddev_samp(kwh).alias("kwh_stddev"),
        F.min(kwh).alias("min_kwh"),
        F.max(kwh).alias("max_kwh"),
    )
    rows = stats.join(_described(buildings), "building_id").withColumn(
        "intensity", ratio(mean(F.col("co2e"), F.col("records")), F.col("sq_footage"))
    )
    rows = with_percentiles(rows, "intensity", (0.25, 0.5, 0.75), "quartiles", partitioned=partitioned)
    rows = with_global_rank(rows, "intensity", rank="efficiency_rank", descending=False, partitioned=partitioned)
    return rows.select(
        "building_id",
        "building_name",
        "primary_use",
        "sq_footage",
        rounded(mean(F.col("kwh"), F.col("records")), 1).alias("avg_daily_kwh"),
        rounded(F.col("intensity"), 6).alias("co2e_per_sqft"),
        "efficiency_rank",
        quartile_rating(F.col("intensity"), F.col("quartiles")).alias("efficiency_rating"),
        rounded(F.col("kwh_stddev"), 1).alias("consumption_variability"),
        "min_kwh",
        "max_kwh",
    ).orderBy("efficiency_rank", "building_id")


def building_performance_ranked(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    days: int = 30,
    highest_first: bool = True,
    partitioned: bool = False,
) -> DataFrame:
    """Emission and intensity ranks over the last days, empty buildings included.

    With `highest_first` the building of the highest intensity gets rank 1 and is rated
    'Excellent'; pass False for a rating in which low intensity is good.
    """
    recent = between_days(energy, "date_time", start=days_before(as_of, days))
    rows = buildings.join(energy_totals(recent, "building_id"), "building_id", "left").select(
        "building_id",
        "name",
        "primary_use",
        "sq_footage",
        or_zero(F.col("co2e")).alias("total_co2e"),
        or_zero(F.col("kwh")).alias("total_consumption_kwh"),
        F.coalesce(ratio(F.col("co2e"), F.col("sq_footage")), F.lit(0.0)).alias("co2e_per_sqft"),
        or_zero(F.col("records")).alias("record_count"),
    )
    rows = with_global_rank(rows, "total_co2e", rank="emission_rank", total="building_total", partitioned=partitioned)
    rows = with_global_rank(rows, "co2e_per_sqft", rank="efficiency_rank", descending=highest_first, partitioned=partitioned)
    rating = rank_percentile_rating(F.col("efficiency_rank"), F.col("building_total"))
    return (
        rows.withColumn("efficiency_rating", rating)
        .drop("building_total")
        .orderBy(F.col("total_co2e").desc(), "building_id")
    )


def _recent_by_building(buildings: DataFrame, energy: DataFrame, as_of, days: int) -> DataFrame:
    recent = between_days(energy, "date_time", start=days_before(as_of, days))
    return buildings.join(energy_totals(recent, "building_id"), "building_id", "left")


def _type_rows(rows: DataFrame, times: Column) -> DataFrame:
    """Totals per use; `times` is how often a building counts."""
    sqft = F.sum(F.col("sq_footage").cast("bigint") * times)
    co2e, records = F.sum("co2e"), F.sum("records")
    return (
        rows.groupBy("primary_use")
        .agg(
            F.sum(times).alias("building_count"),
            sqft.alias("total_sq_footage"),
            mean(sqft, F.sum(times)).alias("avg_sq_footage"),
            or_zero(co2e).alias("total_co2e"),
            F.coalesce(mean(co2e, records), F.lit(0.0)).alias("avg_co2e_per_record"),
            or_zero(F.sum("kwh")).alias("total_consumption_kwh"),
            F.coalesce(ratio(co2e, sqft), F.lit(0.0)).alias("co2e_per_sqft"),
        )
        .orderBy(F.col("total_co2e").desc(), "primary_use")
    )


def building_type_summary(
    buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, days: int = 30
) -> DataFrame:
    """Totals per use with buildings and floor area counted once per reading (once if it has none).

    That is what joining readings to buildings before counting gives; here the fan-out is a
    multiplication instead of a join of raw readings.
    """
    fan_out = F.greatest(or_zero(F.col("records")), F.lit(1)).cast("bigint")
    return _type_rows(_recent_by_building(buildings, energy, as_of, days), fan_out)


def building_type_summary_dedup(
    buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, days: int = 30
) -> DataFrame:
    """As `building_type_summary` with every building counted once."""
    return _type_rows(_recent_by_building(buildings, energy, as_of, days), F.lit(1).cast("bigint"))


def building_recent(
    buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, days: int = 30, building_id=None
) -> DataFrame:
    """Totals and averages of the last days per building, or of one building."""
    chosen = equal_to("building_id", building_id)
    rows = _recent_by_building(where(buildings, chosen), where(energy, chosen), as_of, days)
    co2e, kwh, records = F.col("co2e"), F.col("kwh"), F.col("records")
    return rows.select(
        "building_id",
        F.col("name").alias("building_name"),
        or_zero(records).alias("total_records"),
        or_zero(kwh).alias("total_consumption_kwh"),
        or_zero(co2e).alias("total_co2e_emitted"),
        F.coalesce(mean(kwh, records), F.lit(0.0)).alias("avg_consumption_kwh"),
        F.coalesce(mean(co2e, records), F.lit(0.0)).alias("avg_co2e_emitted"),
        F.when(F.col("sq_footage") > 0, F.coalesce(ratio(co2e, F.col("sq_footage")), F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias("co2e_per_sqft"),
    )


def building_source_mix(
    energy: DataFrame, as_of: dt.date | str, days: int = 30, building_id=None
) -> DataFrame:
    """Totals of the last days per building and source."""
    recent = between_days(energy, "date_time", start=days_before(as_of, days))
    recent = where(recent, equal_to("building_id", building_id))
    return energy_totals(recent, "building_id", "source").select(
        "building_id",
        "source",
        F.col("records").alias("record_count"),
        F.col("kwh").alias("total_consumption_kwh"),
        F.col("co2e").alias("total_co2e_emitted"),
    ).orderBy("building_id", F.col("total_co2e_emitted").desc_nulls_first(), "source")


_PROFILE = ("building_id", "name", "sq_footage", "primary_use", "location_gps", "created_at", "updated_at")


def building_rows(buildings: DataFrame, primary_use: str | None = None, building_id=None) -> DataFrame:
    rows = where(buildings, equal_to("primary_use", primary_use), equal_to("building_id", building_id))
    return rows.select(*_PROFILE)


def building_listing_info(buildings: DataFrame, page: Page = Page(), primary_use: str | None = None) -> DataFrame:
    """Page metadata of the listing."""
    return page_info(building_rows(buildings, primary_use), page)


def building_listing(buildings: DataFrame, page: Page = Page(), primary_use: str | None = None) -> DataFrame:
    """A page of buildings by name; names are unique."""
    rows = building_rows(buildings, primary_use)
    return page_of(rows, [F.col("name").asc_nulls_last(), F.col("building_id")], page)
