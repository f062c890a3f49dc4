"""Checked report parameters: dates, ranges, pages, limits."""

from __future__ import annotations

import calendar
import datetime as dt
import uuid
from dataclasses import dataclass

MAX_PAGE_SIZE = 100

# Reporting periods a user can ask for, in months.
PERIOD_MONTHS = {"1month": 1, "3months": 3, "6months": 6, "1year": 12}


def as_date(value: dt.date | str) -> dt.date:
    """A calendar date from a date or an ISO string; there is no implicit 'today' anywhere."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value)


def months_before(day: dt.date | str, months: int) -> dt.date:
    """Calendar month subtraction, clamped to the end of the shorter month."""
    day = as_date(day)
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def days_before(day: dt.date | str, days: int) -> dt.date:
    return as_date(day) - dt.timedelta(days=check_positive(days, "days"))


def check_positive(value: int, what: str, at_most: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{what} must be a positive integer, got {value!r}")
    if at_most is not None and value > at_most:
        raise ValueError(f"{what} must be between 1 and {at_most}, got {value}")
    return value


def check_uuid(value: str, what: str) -> str:
    """A well-formed UUID, for keys given from outside."""
    try:
        uuid.UUID(value)
    except (ValueError, TypeError, AttributeError):
        raise ValueError(f"{what} must be a valid UUID, got {value!r}") from None
    return value


def check_choice(value: str, choices, what: str) -> str:
    if value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}, got {value!r}")
    return value


@dataclass(frozen=True)
class DateRange:
    """Both ends inclusive."""

    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start: dt.date | str, end: dt.date | str) -> DateRange:
        return cls(as_date(start), as_date(end))

    @classmethod
    def last_days(cls, as_of: dt.date | str, days: int) -> DateRange:
        """`days` back up to and including `as_of`: days + 1 calendar dates."""
        return cls(days_before(as_of, days), as_date(as_of))

    @property
    def period_days(self) -> int:
        return (self.end - self.start).days


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 20

    def __post_init__(self):
        check_positive(self.number, "page")
        check_positive(self.size, "limit", MAX_PAGE_SIZE)

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size
