"""Reports over readings: trends, peaks, sources, listings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbook.functions.exprs import day_of, hour_label, mean, month_of, period_start, ratio, rounded
from cinderbook.operators.paging import page_after, page_at, page_info, page_of
from cinderbook.operators.predicates import between_days, equal_to, visible_readings, where
from cinderbook.operators.totals import co2e_totals, energy_totals, row_count
from cinderbook.params import DateRange, Page, check_choice, days_before, months_before

PERIODS = ("hourly", "daily", "weekly", "monthly")


def energy_source_breakdown(energy: DataFrame, days: DateRange) -> DataFrame:
    return source_rows_of(energy_totals(between_days(energy, "date_time", days.start, days.end), "source"))


def source_rows_of(totals: DataFrame) -> DataFrame:
    """Report rows from totals per source."""
    return totals.select(
        "source",
        F.col("records").alias("record_count"),
        F.col("kwh").alias("total_consumption_kwh"),
        F.col("co2e").alias("total_co2e_kg"),
        mean(F.col("kwh"), F.col("records")).alias("avg_consumption_kwh"),
    ).orderBy(F.col("total_co2e_kg").desc_nulls_first(), "source")


def monthly_energy_trend(energy: DataFrame, as_of: dt.date | str, months: int = 6) -> DataFrame:
    recent = between_days(energy, "date_time", start=months_before(as_of, months))
    totals = co2e_totals(recent, month_of(F.col("date_time")).alias("month"))
    return totals.select("month", F.col("co2e").alias("monthly_co2e")).orderBy("month")


def monthly_building_mom(
    buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, months: int = 6
) -> DataFrame:
    """Monthly totals per building with the change against the month before.

    The window sees the aggregated months of one building, a handful of rows.
    """
    recent = between_days(energy, "date_time", start=months_before(as_of, months))
    monthly = energy_totals(recent, "building_id", month_of(F.col("date_time")).alias("month"))
    before = F.lag("co2e").over(Window.partitionBy("building_id").orderBy("month"))
    change = (F.col("co2e").cast("double") - F.col("before").cast("double")) / F.nullif(
        F.col("before").cast("double"), F.lit(0.0)
    )
    return (
        monthly.withColumn("before", before)
        .join(buildings.select("building_id", F.col("name").alias("building_name")), "building_id")
        .select(
            "month",
            "building_id",
            "building_name",
            F.col("kwh").alias("monthly_kwh"),
            F.col("co2e").alias("monthly_co2e"),
            F.col("before").alias("previous_month_co2e"),
            rounded(change * 100, 2).alias("month_over_month_change_percent"),
        )
        .orderBy(F.col("month").desc(), F.col("monthly_co2e").desc(), "building_id")
    )


def energy_summary_by_building(
    buildings: DataFrame,
    energy: DataFrame,
    days: DateRange,
    as_of: dt.date | str,
    source: str | None = None,
    role: str | None = "admin",
) -> DataFrame:
    """Totals and averages per building in a range; buildings without readings come last."""
    readings = visible_readings(between_days(energy, "date_time", days.start, days.end), role, as_of)
    totals = energy_totals(where(readings, equal_to("source", source)), "building_id")
    records = F.coalesce("records", F.lit(0))
    return buildings.join(totals, "building_id", "left").select(
        "building_id",
        F.col("name").alias("building_name"),
        "primary_use",
        "sq_footage",
        records.alias("total_records"),
        F.col("kwh").alias("total_consumption_kwh"),
        F.col("co2e").alias("total_co2e_emitted"),
        mean(F.col("kwh"), F.col("records")).alias("avg_consumption_kwh"),
        mean(F.col("co2e"), F.col("records")).alias("avg_co2e_emitted"),
        ratio(F.col("co2e"), F.col("sq_footage")).alias("co2e_per_sqft"),
    ).orderBy(F.col("total_co2e_emitted").desc_nulls_last(), "building_id")


def energy_trends(
    energy: DataFrame,
    days: DateRange,
    as_of: dt.date | str,
    period: str = "daily",
    building_id=None,
    source: str | None = None,
    role: str | None = "admin",
) -> DataFrame:
    """Time series by hour, day, ISO week or month."""
    check_choice(period, PERIODS, "period")
    readings = visible_readings(between_days(energy, "date_time", days.start, days.end), role, as_of)
    readings = where(readings, equal_to("building_id", building_id), equal_to("source", source))
    totals = energy_totals(readings, period_start(F.col("date_time"), period).alias("period"))
    return totals.select(
        "period",
        F.col("records").alias("record_count"),
        F.col("kwh").alias("total_consumption_kwh"),
        F.col("co2e").alias("total_co2e_emitted"),
        mean(F.col("kwh"), F.col("records")).alias("avg_consumption_kwh"),
        mean(F.col("co2e"), F.col("records")).alias("avg_co2e_emitted"),
    ).orderBy("period")


def peak_hours(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    days: int = 30,
    building_id=None,
    ranks: int = 3,
) -> DataFrame:
    """The hours of day with the highest mean consumption per building; ties share a rank.

    At most 24 aggregated rows per building reach the window.
    """
    recent = between_days(energy, "date_time", start=days_before(as_of, days))
    recent = where(recent, equal_to("building_id", building_id))
    hourly = energy_totals(recent, "building_id", F.hour("date_time").alias("hour")).select(
        "building_id",
        "hour",
        mean(F.col("kwh"), F.col("records")).alias("avg_kwh"),
        mean(F.col("co2e"), F.col("records")).alias("avg_co2e"),
    )
    by_kwh = Window.partitionBy("building_id").orderBy(F.col("avg_kwh").desc_nulls_first())
    return (
        hourly.withColumn("consumption_rank", F.rank().over(by_kwh).cast("bigint"))
        .filter(F.col("consumption_rank") <= ranks)
        .join(buildings.select("building_id", F.col("name").alias("building_name")), "building_id")
        .select(
            "building_name",
            hour_label(F.col("hour")).alias("peak_hour"),
            rounded(F.col("avg_kwh"), 1).alias("peak_kwh"),
            rounded(F.col("avg_co2e"), 3).alias("peak_co2e_kg"),
            "consumption_rank",
        )
        .orderBy("building_name", "consumption_rank", "peak_hour")
    )


def daily_energy_activity(energy: DataFrame, days: DateRange, limit: int = 30) -> DataFrame:
    """Emissions and number of reporting buildings per day, latest days first.

    Aggregated per day and building first, so that the distinct count is a plain count.
    """
    readings = between_days(energy, "date_time", days.start, days.end)
    per_building = co2e_totals(readings, day_of(F.col("date_time")).alias("date"), "building_id")
    return (
        per_building.groupBy("date")
        .agg(
            F.sum("co2e").alias("daily_energy_co2e"),
            F.count("building_id").alias("active_buildings"),
        )
        .orderBy(F.col("date").desc())
        .limit(limit)
    )


_FACT_COLUMNS = ("record_id", "building_id", "date_time", "source", "consumption_kwh", "co2e_emitted")


def _listed(
    energy: DataFrame,
    as_of: dt.date | str,
    building_id=None,
    source: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    role: str | None = None,
) -> DataFrame:
    readings = visible_readings(between_days(energy, "date_time", start, end), role, as_of)
    return where(readings, equal_to("building_id", building_id), equal_to("source", source)).select(*_FACT_COLUMNS)


def _described(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    described = buildings.select("building_id", F.col("name").alias("building_name"), "primary_use", "sq_footage")
    own = [c for c in _FACT_COLUMNS if c != "building_id"]
    return readings.join(described, "building_id").select(*own, "building_name", "primary_use", "sq_footage")


def readings_with_building(buildings: DataFrame, energy: DataFrame, as_of: dt.date | str, **filters) -> DataFrame:
    """The filtered rows behind the readings listing."""
    return _described(_listed(energy, as_of, **filters), buildings)


def energy_listing(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    page: Page = Page(1, 50),
    tie_break: Sequence[str] = ("record_id",),
    **filters,
) -> DataFrame:
    """A page of readings, newest first.

    Ties broken by columns of the readings let the page be found among readings alone: only its rows meet the buildings.
    """
    order = [F.col(c).desc_nulls_last() for c in tie_break]
    newest = F.col("date_time").desc_nulls_first()
    if not set(tie_break) <= set(_FACT_COLUMNS):
        return page_of(readings_with_building(buildings, energy, as_of, **filters), [newest, *order], page)
    rows = page_at(_listed(energy, as_of, **filters), "date_time", order, page, buildings, "building_id")
    # The page has at most Page.size rows.
    ties = [c for c in tie_break if c != "building_id"]
    return _described(F.broadcast(rows), buildings).orderBy(newest, *[F.col(c).desc_nulls_last() for c in ties])


def energy_listing_after(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    last_seen: tuple,
    size: int = 50,
    **filters,
) -> DataFrame:
    """The readings following (date_time, record_id), newest first."""
    rows = readings_with_building(buildings, energy, as_of, **filters)
    return page_after(rows, ("date_time", "record_id"), last_seen, size)


def energy_listing_info(
    buildings: DataFrame,
    energy: DataFrame,
    as_of: dt.date | str,
    page: Page = Page(1, 50),
    building_id=None,
    source: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    role: str | None = None,
) -> DataFrame:
    """Page metadata of the listing: readings are counted per building before they meet the buildings."""
    readings = visible_readings(between_days(energy, "date_time", start, end), role, as_of)
    readings = where(readings, equal_to("building_id", building_id), equal_to("source", source))
    counts = readings.groupBy("building_id").agg(row_count().alias("rows"))
    return page_info(counts.join(buildings.select("building_id"), "building_id"), page, "rows")
