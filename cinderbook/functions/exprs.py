"""Derived metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display orders of initiative status; anything not listed comes last.
EFFECTIVENESS_ORDER = ("active", "completed", "planned")
LISTING_ORDER = ("active", "planned", "completed")

# Fixed value: text form of a position.
POINT = r"^POINT\((-?\d+\.?\d*)\s+(-?\d+\.?\d*)\)$"


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero.  Goes through decimal: a binary double rounds unreliably at ties."""
    return F.round(value.cast("decimal(28,8)"), digits)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when whole is zero or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def mean(total: Column, count: Column) -> Column:
    """Average from an exact sum and a count, so that it does not depend on summation order."""
    return ratio(total, count)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def change_percent(now: Column, before: Column, digits: int = 1) -> Column:
    """Change against a base, NULL when the base is not above zero."""
    change = (now.cast("double") - before.cast("double")) / before.cast("double") * 100
    return F.when(before > 0, rounded(change, digits))


def achievement_rate(actual: Column, target: Column) -> Column:
    """Share of the target reached in percent, 0 when there is no positive target."""
    return F.when(
        target > 0, rounded(F.coalesce(ratio(actual, target), F.lit(0.0)) * 100, 1)
    ).otherwise(F.lit(0))


def achievement_percentage(actual: Column, target: Column) -> Column:
    """As `achievement_rate`, but NULL without a target."""
    return rounded(ratio(actual, target) * 100, 1)


def _steps(value: Column, steps, otherwise: str, reaches) -> Column:
    chain = F
    for bound, label in steps:
        chain = chain.when(reaches(value, bound), F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def effectiveness_rating(percentage: Column) -> Column:
    """A NULL percentage falls through to the last rating."""
    steps = ((100, "Excellent"), (75, "Good"), (50, "Fair"))
    return _steps(percentage, steps, "Needs Improvement", lambda v, b: v >= b)


def rank_percentile_rating(rank: Column, total: Column) -> Column:
    """Rating by position in a ranking: rank 1 of N gives 1.0, rank N gives 1/N."""
    position = (total - rank + 1).cast("double") / total.cast("double")
    steps = ((0.75, "Excellent"), (0.5, "Good"), (0.25, "Average"))
    return _steps(position, steps, "Needs Improvement", lambda v, b: v >= b)


def quartile_rating(value: Column, quartiles: Column) -> Column:
    """Rating by the quartile cut points [p25, p50, p75]; low values are good."""
    steps = ((quartiles[0], "Excellent"), (quartiles[1], "Good"), (quartiles[2], "Average"))
    return _steps(value, steps, "Needs Improvement", lambda v, b: v < b)


def status_order(status: Column, order=LISTING_ORDER) -> Column:
    chain = F
    for place, name in enumerate(order, start=1):
        chain = chain.when(status == name, F.lit(place))
    return chain.otherwise(F.lit(len(order) + 1))


def full_name(first: Column, last: Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def hour_label(hour: Column) -> Column:
    return F.concat(hour.cast("string"), F.lit(":00"))


def tonnes(kilograms: Column) -> Column:
    return F.round(kilograms.cast("decimal(38,8)") / F.lit(1000), 3)


def duration_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def month_of(timestamp: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(F.to_date(timestamp), "month")


def period_start(timestamp: Column, period: str) -> Column:
    """Start of the hour, day, ISO week or month as TIMESTAMP_NTZ, whatever the session time zone."""
    day = F.to_date(timestamp)
    if period == "hourly":
        hours = F.make_dt_interval(F.lit(0), F.hour(timestamp))
        return day.cast("timestamp_ntz") + hours
    if period == "weekly":
        day = F.trunc(day, "week")
    elif period == "monthly":
        day = F.trunc(day, "month")
    return day.cast("timestamp_ntz")


def point(text: Column) -> Column:
    """Parse `POINT(x y)` into a struct, NULL when the text has another form."""
    x = F.regexp_extract(text, POINT, 1).try_cast("double")
    y = F.regexp_extract(text, POINT, 2).try_cast("double")
    return F.when(text.rlike(POINT), F.struct(x.alias("x"), y.alias("y")))
