"""One-day reports: a day against the day before and against the 30-day mean.

Each fact is scanned once, for the days the report needs, and every figure is a conditional
aggregate over the per-day totals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.functions.exprs import change_percent, day_of, mean, or_zero, ratio, rounded
from cinderbook.operators.predicates import between_days
from cinderbook.operators.totals import co2e_totals, one_row
from cinderbook.params import as_date, days_before

MEAN_DAYS = 30


def _per_day(fact: DataFrame, time_column: str, start, end=None) -> DataFrame:
    return co2e_totals(between_days(fact, time_column, start, end), day_of(F.col(time_column)).alias("day"))


def _on(day: dt.date) -> Column:
    return F.coalesce(F.sum(F.when(F.col("day") == F.lit(day), F.col("co2e"))), F.lit(0))


def daily_dashboard(energy: DataFrame, trips: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Today against yesterday and against the mean energy day of the last 30 days up to now.

    The mean covers energy only and includes today (and any later day in the data).
    """
    today = as_date(as_of)
    yesterday = days_before(today, 1)
    parts = one_row(
        energy.sparkSession,
        energy=_per_day(energy, "date_time", days_before(today, MEAN_DAYS)).agg(
            _on(today).alias("today"),
            _on(yesterday).alias("yesterday"),
            mean(F.sum("co2e"), F.count("co2e")).alias("mean"),
        ),
        trips=_per_day(trips, "date", yesterday, today).agg(
            _on(today).alias("today"), _on(yesterday).alias("yesterday")
        ),
    )
    total = F.col("energy.today") + F.col("trips.today")
    before = F.col("energy.yesterday") + F.col("trips.yesterday")
    average = F.col("energy.mean")
    return parts.select(
        F.lit(today).alias("report_date"),
        F.round("energy.today", 2).alias("today_energy_co2e_kg"),
        F.round("trips.today", 2).alias("today_transport_co2e_kg"),
        F.round(total, 2).alias("today_total_co2e_kg"),
        F.round(before, 2).alias("yesterday_total_co2e_kg"),
        rounded(average, 2).alias("monthly_avg_co2e_kg"),
        rounded(ratio(total - before, before) * 100, 1).alias("day_over_day_change_percent"),
        rounded(ratio(total.cast("double") - average, average) * 100, 1).alias("vs_monthly_avg_percent"),
    )


def daily_summary(energy: DataFrame, trips: DataFrame, day: dt.date | str) -> DataFrame:
    """A given day with activity counts; the 30-day mean leaves the day itself out.

    Readings are reduced to one row per day and building, trips to one per day and user, so the
    distinct counts are plain counts.
    """
    day = as_date(day)
    before = days_before(day, 1)
    readings = between_days(energy, "date_time", days_before(day, MEAN_DAYS), day)
    per_building = co2e_totals(readings, day_of(F.col("date_time")).alias("day"), "building_id")
    per_day = per_building.groupBy("day").agg(
        F.sum("co2e").alias("co2e"), F.count("building_id").alias("active")
    )
    earlier = F.when(F.col("day") < F.lit(day), F.col("co2e"))
    per_user = co2e_totals(between_days(trips, "date", before, day), F.col("date").alias("day"), "user_id")
    active = F.max(F.when(F.col("day") == F.lit(day), F.col("active")))
    parts = one_row(
        energy.sparkSession,
        energy=per_day.agg(
            _on(day).alias("today"),
            _on(before).alias("before"),
            mean(F.sum(earlier), F.count(earlier)).alias("mean"),
            or_zero(active).alias("active"),
        ),
        trips=per_user.agg(
            _on(day).alias("today"),
            _on(before).alias("before"),
            F.count_if(F.col("day") == F.lit(day)).alias("active"),
        ),
    )
    total = F.col("energy.today") + F.col("trips.today")
    previous = F.col("energy.before") + F.col("trips.before")
    average = F.coalesce("energy.mean", F.lit(0.0))
    return parts.select(
        F.lit(day).alias("report_date"),
        F.round(total, 2).alias("total_co2e_kg"),
        F.round("energy.today", 2).alias("energy_co2e_kg"),
        F.round("trips.today", 2).alias("transport_co2e_kg"),
        F.round(previous, 2).alias("previous_day_total"),
        rounded(average, 2).alias("monthly_average"),
        change_percent(total, previous).alias("day_over_day_change"),
        change_percent(total, average).alias("vs_monthly_average"),
        F.col("energy.active").alias("active_buildings"),
        F.col("trips.active").alias("active_users"),
    )


def realtime_snapshot(energy: DataFrame, trips: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Today so far against yesterday."""
    today = as_date(as_of)
    yesterday = days_before(today, 1)
    halves = {
        name: _per_day(fact, column, yesterday, today).agg(
            _on(today).alias("today"), _on(yesterday).alias("yesterday")
        )
        for name, fact, column in (("energy", energy, "date_time"), ("trips", trips, "date"))
    }
    parts = one_row(energy.sparkSession, **halves)
    total = F.col("energy.today") + F.col("trips.today")
    before = F.col("energy.yesterday") + F.col("trips.yesterday")
    return parts.select(
        F.lit(today).alias("report_date"),
        F.col("energy.today").alias("energy_co2e"),
        F.col("trips.today").alias("transport_co2e"),
        total.alias("total_co2e"),
        before.alias("yesterday_total"),
        change_percent(total, before).alias("change_percent"),
    )
