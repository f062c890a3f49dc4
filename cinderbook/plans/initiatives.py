"""Reports over reduction initiatives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.functions.exprs import (
    EFFECTIVENESS_ORDER,
    LISTING_ORDER,
    achievement_percentage,
    achievement_rate,
    duration_days,
    effectiveness_rating,
    full_name,
    mean,
    or_zero,
    ratio,
    rounded,
    status_order,
)
from cinderbook.operators.paging import page_info, page_of, top
from cinderbook.operators.predicates import equal_to, masked_email, where
from cinderbook.operators.totals import row_count
from cinderbook.params import Page, as_date


def _target() -> Column:
    return F.col("target_reduction_tco2e")


def _actual() -> Column:
    return F.col("actual_reduction_tco2e")


def _with_creator(initiatives: DataFrame, users: DataFrame) -> DataFrame:
    creators = users.select(
        F.col("user_id").alias("created_by"),
        F.col("first_name").alias("creator_first"),
        F.col("last_name").alias("creator_last"),
        F.col("email").alias("creator_email"),
    )
    return initiatives.join(creators, "created_by", "left")


def initiative_effectiveness(
    initiatives: DataFrame, users: DataFrame, as_of: dt.date | str, newest_first: bool = False
) -> DataFrame:
    """Achievement, planned and actual duration, creator and rating of every initiative.

    Within a status the best achievement comes first, or the newest with `newest_first`.  The
    duration of a completed initiative runs up to `as_of`, not to its end date.
    """
    today = F.lit(as_date(as_of))
    status = F.col("status")
    running = (status == "active") | ((status == "completed") & F.col("end_date").isNotNull())
    rows = _with_creator(initiatives, users).select(
        "initiative_id",
        F.col("name").alias("initiative_name"),
        "status",
        "target_reduction_tco2e",
        "actual_reduction_tco2e",
        achievement_percentage(_actual(), _target()).alias("achievement_percentage"),
        duration_days(F.col("start_date"), F.col("end_date")).cast("bigint").alias("planned_duration_days"),
        F.when(running, duration_days(F.col("start_date"), today).cast("bigint")).alias("actual_duration_days"),
        full_name(F.col("creator_first"), F.col("creator_last")).alias("created_by_name"),
        "created_at",
        "start_date",
        "end_date",
    )
    second = F.col("created_at").desc_nulls_first() if newest_first else F.col("achievement_percentage").desc_nulls_last()
    return rows.withColumn("effectiveness_rating", effectiveness_rating(F.col("achievement_percentage"))).orderBy(
        status_order(status, EFFECTIVENESS_ORDER), second, "initiative_id"
    )


def initiative_effectiveness_summary(initiatives: DataFrame) -> DataFrame:
    """One row over active and completed initiatives."""
    status = F.col("status")
    # Shares are added in decimal: the mean must not depend on the order of rows.
    share = F.when(_target() > 0, (ratio(_actual(), _target()) * 100).cast("decimal(28,8)"))
    return initiatives.filter(status.isin("active", "completed")).agg(
        row_count().alias("total_initiatives"),
        F.count_if(status == "completed").alias("completed_count"),
        F.count_if(status == "active").alias("active_count"),
        or_zero(F.sum(_target())).alias("total_target"),
        or_zero(F.sum(_actual())).alias("total_actual"),
        rounded(F.coalesce(mean(F.sum(share), F.count(share)), F.lit(0.0)), 1).alias("avg_achievement_rate"),
    )


def _counts(*statuses: str) -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"{s}_initiatives") for s in statuses]


def initiative_progress(initiatives: DataFrame) -> DataFrame:
    target, actual = or_zero(F.sum(_target())), or_zero(F.sum(_actual()))
    return initiatives.agg(
        row_count().alias("total_initiatives"),
        *_counts("active", "completed"),
        target.alias("total_target_reduction"),
        actual.alias("total_actual_reduction"),
        achievement_rate(actual, target).alias("achievement_rate"),
    )


def initiative_overview(initiatives: DataFrame) -> DataFrame:
    target, actual = or_zero(F.sum(_target())), or_zero(F.sum(_actual()))
    return initiatives.agg(
        row_count().alias("total_initiatives"),
        *_counts("active", "completed", "planned"),
        target.alias("total_target_reduction"),
        actual.alias("total_actual_reduction"),
        F.coalesce(mean(target, F.count(_target())), F.lit(0.0)).alias("avg_target_reduction"),
        F.coalesce(mean(actual, F.count(_actual())), F.lit(0.0)).alias("avg_actual_reduction"),
        achievement_rate(actual, target).alias("overall_achievement_rate"),
    )


def initiative_status_breakdown(initiatives: DataFrame) -> DataFrame:
    target, actual = or_zero(F.sum(_target())), or_zero(F.sum(_actual()))
    return initiatives.groupBy("status").agg(
        row_count().alias("initiative_count"),
        target.alias("total_target"),
        actual.alias("total_actual"),
        F.coalesce(mean(target, F.count(_target())), F.lit(0.0)).alias("avg_target"),
        F.coalesce(mean(actual, F.count(_actual())), F.lit(0.0)).alias("avg_actual"),
        achievement_rate(actual, target).alias("achievement_rate"),
    ).orderBy(status_order(F.col("status"), LISTING_ORDER), "status")


def top_initiatives(initiatives: DataFrame, limit: int = 5) -> DataFrame:
    """Best achievement among active and completed initiatives that have a target."""
    rows = initiatives.filter(F.col("status").isin("active", "completed") & (_target() > 0)).select(
        "initiative_id",
        "name",
        "target_reduction_tco2e",
        "actual_reduction_tco2e",
        "status",
        (ratio(_actual(), _target()) * 100).alias("exact_rate"),
    )
    best = top(rows, [F.col("exact_rate").desc_nulls_first(), F.col("initiative_id")], limit)
    return best.withColumn("achievement_rate", rounded(F.col("exact_rate"), 1)).drop("exact_rate")


def active_initiatives_top(initiatives: DataFrame, limit: int = 5) -> DataFrame:
    """Active initiatives with the largest target; a missing target sorts first."""
    rows = initiatives.filter(F.col("status") == "active").select(
        "initiative_id",
        "name",
        "description",
        "target_reduction_tco2e",
        "actual_reduction_tco2e",
        "status",
        "start_date",
        "end_date",
    )
    return top(rows, [_target().desc_nulls_first(), F.col("initiative_id")], limit)


def initiative_rows(
    initiatives: DataFrame,
    users: DataFrame,
    status: str | None = None,
    initiative_id=None,
    role: str | None = None,
) -> DataFrame:
    """Initiatives with creator and achievement; e-mail addresses only for admins."""
    chosen = where(initiatives, equal_to("status", status), equal_to("initiative_id", initiative_id))
    return _with_creator(chosen, users).select(
        "initiative_id",
        "name",
        "description",
        or_zero(_target()).alias("target_reduction_tco2e"),
        or_zero(_actual()).alias("actual_reduction_tco2e"),
        achievement_rate(_actual(), _target()).alias("achievement_rate"),
        "status",
        "start_date",
        "end_date",
        "created_at",
        "updated_at",
        full_name(F.col("creator_first"), F.col("creator_last")).alias("created_by_name"),
        masked_email(F.col("creator_email"), role).alias("created_by_email"),
    )


def initiative_listing(
    initiatives: DataFrame, users: DataFrame, page: Page = Page(), status: str | None = None, role: str | None = None
) -> DataFrame:
    """A page of initiatives by status, newest first."""
    rows = initiative_rows(initiatives, users, status=status, role=role)
    order = [
        status_order(F.col("status"), LISTING_ORDER),
        F.col("created_at").desc_nulls_first(),
        F.col("initiative_id"),
    ]
    return page_of(rows, order, page)


def initiative_listing_info(initiatives: DataFrame, page: Page = Page(), status: str | None = None) -> DataFrame:
    return page_info(where(initiatives, equal_to("status", status)), page)
