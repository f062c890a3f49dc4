import datetime as dt
from decimal import Decimal

import pytest

from cinderbook.operators import quality

KEY = "6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5b"


def errors(checked):
    return [r.errors for r in checked.collect()]


def test_readings(spark):
    rows = [
        (KEY, "2024-06-15T10:30:00Z", "gas", "12.345"),
        (KEY, "2024-06-15T10:30:00+02:00", "gas", "0"),
        (KEY, "2024-06-15", "steam", "1000000"),
        ("nope", "15/06/2024", "wind", "1000000.01"),
        (None, None, None, None),
        (KEY, "2024-02-30", "fuel", "NaN"),
        (KEY, "2024-06-15 25:00", "fuel", "-1"),
        (KEY, "2024-06-15", "fuel", "1e3"),
    ]
    df = spark.createDataFrame(rows, "building_id STRING, date_time STRING, source STRING, consumption_kwh STRING")
    checked = quality.check_readings(df)
    got = checked.collect()
    assert [len(r.errors) for r in got] == [0, 0, 0, 4, 4, 2, 2, 0]
    assert (got[0].date_time, got[0].consumption_kwh) == (dt.datetime(2024, 6, 15, 10, 30), Decimal("12.35"))
    assert got[1].date_time == dt.datetime(2024, 6, 15, 8, 30)
    assert got[7].consumption_kwh == 1000
    assert quality.accepted(checked).count() + quality.rejected(checked).count() == len(rows)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-06-15T10:30:00+02:00",), ("2024-03-10T02:30:00",)], "t STRING")
        got = [r.t for r in df.select(quality.iso_timestamp(df["t"]).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.datetime(2024, 6, 15, 8, 30), dt.datetime(2024, 3, 10, 2, 30)]


def test_trips(spark):
    rows = [("2024-06-15", "car", "10000"), ("2024-06-15", "car", "10000.5"), ("2024-06-15", "Car", "1"), ("x", "bus", "x")]
    df = spark.createDataFrame(rows, "date STRING, mode STRING, distance_km STRING")
    assert [len(e) for e in errors(quality.check_trips(df))] == [0, 1, 1, 2]
    assert quality.check_trips(df).first().date == dt.date(2024, 6, 15)


def test_users(spark):
    rows = [
        (" Jo.Doe@Uni.EDU ", " Jo ", "Doe", None),
        ("jo@uni", "J", "Doe", "x" * 101),
        ("jo doe@uni.edu", "Jo", "D" * 51, "IT"),
        (None, None, "Doe", "IT"),
    ]
    df = spark.createDataFrame(rows, "email STRING, first_name STRING, last_name STRING, department STRING")
    checked = quality.check_users(df)
    assert [len(e) for e in errors(checked)] == [0, 3, 2, 2]
    assert (checked.first().email, checked.first().first_name) == ("jo.doe@uni.edu", "Jo")


def test_buildings(spark):
    rows = [
        ("Hall", "1", "Academic", "POINT(-74.006 40.7)"),
        ("H", "0", "A", "POINT(1,2)"),
        ("Hall", "10000001", "Academic", None),
        ("Hall", "12.5", "Academic", "POINT(1 2) x"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name STRING, sq_footage STRING, primary_use STRING, location_gps STRING")
    checked = quality.check_buildings(df)
    assert [len(e) for e in errors(checked)] == [0, 4, 1, 2, 3]
    assert tuple(checked.first().location_gps) == (-74.006, 40.7)


def test_initiatives(spark):
    rows = [
        ("LED", None, None, None, None, None),
        (" x ", "d" * 1001, "-1", "lost", "soon", "2024-13-01"),
        ("Solar", "d" * 1000, "0", "active", "2024-01-01", "2024-02-29"),
    ]
    df = spark.createDataFrame(
        rows,
        "name STRING, description STRING, target_reduction_tco2e STRING, status STRING, start_date STRING, end_date STRING",
    )
    assert [len(e) for e in errors(quality.check_initiatives(df))] == [0, 6, 0]
