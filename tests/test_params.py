import datetime as dt

import pytest

from cinderbook.params import DateRange, Page, as_date, check_positive, check_uuid, days_before, months_before


def test_month_arithmetic_clamps():
    assert months_before("2024-03-31", 1) == dt.date(2024, 2, 29)
    assert months_before("2023-03-31", 1) == dt.date(2023, 2, 28)
    assert months_before("2024-01-15", 1) == dt.date(2023, 12, 15)
    assert months_before("2024-02-29", 12) == dt.date(2023, 2, 28)
    assert months_before("2001-07-01", 3) == dt.date(2001, 4, 1)


def test_dates():
    assert as_date(dt.datetime(2001, 7, 1, 5)) == dt.date(2001, 7, 1)
    with pytest.raises(ValueError):
        as_date("yesterday")


def test_range_has_one_date_more_than_days():
    days = DateRange.last_days("2001-07-01", 30)
    assert days.start == dt.date(2001, 6, 1) == days_before("2001-07-01", 30)
    assert days.period_days == 30


@pytest.mark.parametrize("number,size", [(0, 20), (1, 0), (1, 101), (-1, 5), (1.5, 5), (True, 5)])
def test_bad_pages(number, size):
    with pytest.raises(ValueError):
        Page(number, size)


def test_uuid():
    key = "6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5b"
    assert check_uuid(key, "building_id") == key
    for bad in ("b1", None, 7):
        with pytest.raises(ValueError):
            check_uuid(bad, "building_id")


def test_positive():
    assert check_positive(3, "days") == 3
    with pytest.raises(ValueError):
        check_positive("3", "days")
    assert Page(6, 20).offset == 100
