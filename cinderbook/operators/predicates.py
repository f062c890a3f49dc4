"""Filters: optional predicates, time bounds and row visibility by role."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.params import as_date, days_before
from cinderbook.schemas import MONTH_COLUMN

# How far back somebody without the admin role sees readings.
PUBLIC_DAYS = 30


def equal_to(column: str, value) -> Column | None:
    """Equality with a bound value; no predicate at all when the value is not given."""
    return None if value is None else F.col(column) == F.lit(value)


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Keep rows meeting every given predicate; `None` stands for 'not asked for'."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def between_days(
    df: DataFrame,
    column: str,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """Rows from the start of day `start` to the end of day `end`, either side open.

    Half-open comparison with date constants, which reaches the Parquet scan.  On a table
    written by months the same bounds also prune partitions.
    """
    predicates = []
    if start is not None:
        start = as_date(start)
        predicates.append(F.col(column) >= F.lit(start))
        if MONTH_COLUMN in df.columns:
            predicates.append(F.col(MONTH_COLUMN) >= F.lit(start.replace(day=1)))
    if end is not None:
        end = as_date(end)
        predicates.append(F.col(column) < F.lit(end + dt.timedelta(days=1)))
        if MONTH_COLUMN in df.columns:
            predicates.append(F.col(MONTH_COLUMN) <= F.lit(end.replace(day=1)))
    return where(df, *predicates)


def visible_readings(df: DataFrame, role: str | None, as_of: dt.date | str) -> DataFrame:
    """Admins see every reading, everybody else the last 30 days."""
    if role == "admin":
        return df
    return between_days(df, "date_time", start=days_before(as_of, PUBLIC_DAYS))


def own_trips(df: DataFrame, role: str | None, user_id) -> DataFrame:
    """Admins see all trips, a user only their own, a visitor none."""
    if role == "admin":
        return df
    return df.filter(F.col("user_id") == F.lit(user_id))


def masked_email(email: Column, role: str | None) -> Column:
    """Only admins see e-mail addresses."""
    return email if role == "admin" else F.lit(None).cast("string")
