"""Small cases with answers worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cinderbook.functions import exprs
from cinderbook.functions.factors import with_energy_co2e
from cinderbook.operators import paging, predicates, totals
from cinderbook.params import DateRange, Page
from cinderbook.plans import buildings, daily, energy, initiatives, overview, transport
from cinderbook.schemas import Ledger, check_schema
from cinderbook.sources.binding import ledger
from tests.conftest import building_frame, energy_frame, initiative_frame, trip_frame, user_frame

AS_OF = "2024-06-30"


def one(df, column):
    return df.first()[column]


def by(df, key, column):
    return {row[key]: row[column] for row in df.collect()}


def test_energy_factors(spark):
    rows = [(s, "b", "2024-01-01", s, 100) for s in ("electricity", "gas", "fuel", "steam", "wind")]
    rows += [("up", "b", "2024-01-01", "gas", "1.25"), ("half", "b", "2024-01-01", "gas", "0.75")]
    got = by(energy_frame(spark, rows), "record_id", "co2e_emitted")
    assert got == {
        "electricity": Decimal("0.0400"),
        "gas": Decimal("0.0200"),
        "fuel": Decimal("0.0300"),
        "steam": Decimal("0.0100"),
        "wind": Decimal("0.0000"),
        "up": Decimal("0.0003"),
        "half": Decimal("0.0002"),
    }


def test_trip_factors(spark):
    modes = ("car", "bus", "bike", "walk", "air", "train", "metro", "sled")
    got = by(trip_frame(spark, [(m, "u", "2024-01-01", m, 10) for m in modes]), "trip_id", "co2e_emitted")
    assert [str(got[m]) for m in modes] == [
        "2.1000", "0.8000", "0.0000", "0.0000", "2.5000", "0.4000", "0.3000", "1.5000"
    ]


def test_factor_table(spark):
    readings = energy_frame(spark, [("a", "b", "2024-01-01", "gas", 100), ("c", "b", "2024-01-01", "fuel", 100)])
    table = spark.createDataFrame([("gas", "0.0010")], "key STRING, factor STRING")
    got = with_energy_co2e(readings.drop("co2e_emitted"), table)
    assert by(got, "record_id", "co2e_emitted") == {"a": Decimal("0.1000"), "c": Decimal("0.0000")}
    twice = spark.createDataFrame([("gas", "0.0010"), ("gas", "0.0020")], "key STRING, factor STRING")
    with pytest.raises(Exception, match="two factors"):
        with_energy_co2e(readings, twice).collect()


def test_exact_sum_equals_plain_sum(spark):
    values = [Decimal(v) for v in ("99999999.99", "0.01", "-0.05", "-12345678.91", "1.10")] + [None]
    df = spark.createDataFrame([(v,) for v in values], "consumption_kwh DECIMAL(10,2)")
    row = df.agg(totals.exact_sum(df, "consumption_kwh").alias("a"), F.sum("consumption_kwh").alias("b")).first()
    assert row.a == row.b
    empty = df.filter("false").agg(totals.exact_sum(df, "consumption_kwh").alias("a"))
    assert one(empty, "a") is None
    assert empty.schema["a"].dataType == df.agg(F.sum("consumption_kwh")).schema[0].dataType


def test_rounding_is_half_away_from_zero(spark):
    row = spark.range(1).select(
        exprs.rounded(F.lit(-0.125), 2).alias("a"),
        exprs.rounded(F.lit(235.0499998), 1).alias("b"),
        exprs.rounded(F.lit(2.5), 0).alias("c"),
    )
    assert [str(v) for v in row.first()] == ["-0.13", "235.0", "3"]


def test_metrics(spark):
    cases = [("12.3", "15.5"), ("0", "45.2"), ("5.2", "5.2"), ("1", "0"), ("1", None), (None, "4")]
    df = spark.createDataFrame(cases, "a STRING, t STRING").selectExpr(
        "CAST(a AS DECIMAL(10,2)) AS a", "CAST(t AS DECIMAL(10,2)) AS t"
    )
    share = exprs.achievement_percentage(F.col("a"), F.col("t"))
    rows = df.select(
        share.alias("share"),
        exprs.effectiveness_rating(share).alias("rating"),
        exprs.achievement_rate(F.col("a"), F.col("t")).alias("rate"),
    ).collect()
    assert [None if r.share is None else float(r.share) for r in rows] == [79.4, 0.0, 100.0, None, None, None]
    assert [r.rating for r in rows] == ["Good"] + ["Needs Improvement"] + ["Excellent"] + ["Needs Improvement"] * 3
    assert [float(r.rate) for r in rows] == [79.4, 0, 100, 0, 0, 0]
    change = spark.createDataFrame([(15.0, 10.0), (5.0, 0.0), (5.0, None)], "n DOUBLE, b DOUBLE").select(
        exprs.change_percent(F.col("n"), F.col("b")).alias("c")
    )
    assert [None if r.c is None else float(r.c) for r in change.collect()] == [50.0, None, None]


def test_durations_and_labels(spark):
    row = spark.range(1).selectExpr("DATE'2024-01-15' AS s", "DATE'2024-06-30' AS e", "CAST(NULL AS DATE) AS n").select(
        exprs.duration_days(F.col("s"), F.col("e")).alias("d"),
        exprs.duration_days(F.col("s"), F.col("n")).alias("none"),
        exprs.hour_label(F.lit(7)).alias("hour"),
        exprs.full_name(F.lit("A"), F.lit(None).cast("string")).alias("name"),
        exprs.tonnes(F.lit(Decimal("1234.56"))).alias("t"),
    )
    d, none, hour, name, t = row.first()
    assert (d, none, hour, name, float(t)) == (167, None, "7:00", None, 1.235)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_period_start_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).selectExpr("TIMESTAMP_NTZ'2024-03-10 02:30:00' AS t")
        got = df.select(*[exprs.period_start(F.col("t"), p).alias(p) for p in energy.PERIODS]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert list(got) == [
        dt.datetime(2024, 3, 10, 2),
        dt.datetime(2024, 3, 10),
        dt.datetime(2024, 3, 4),
        dt.datetime(2024, 3, 1),
    ]


def test_lag_change(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    kwh = {"2024-03-05": 25000, "2024-04-05": 37500, "2024-05-05": 0, "2024-06-05": 12500}
    e = energy_frame(spark, [(d, "b", d, "electricity", k) for d, k in kwh.items()])
    rows = energy.monthly_building_mom(b, e, AS_OF).orderBy("month").collect()
    got = [None if r.month_over_month_change_percent is None else float(r.month_over_month_change_percent) for r in rows]
    assert got == [None, 50.0, -100.0, None]


def test_left_join_with_null_tolerant_filter(spark):
    users = user_frame(spark, [(u, "user", "X") for u in ("old", "new", "none", "undated")] + [("boss", "admin", "X")])
    trips = trip_frame(
        spark,
        [
            ("1", "old", "2023-01-01", "car", 5),
            ("2", "new", "2024-06-01", "car", 5),
            ("3", "new", "2024-06-02", "bus", 5),
            ("4", "new", "2023-06-02", "air", 5),
            ("5", "new", "2024-06-03", "car", 5),
            ("6", "undated", None, "walk", 5),
            ("7", "boss", "2024-06-01", "car", 5),
        ],
    )
    stats = by(transport.user_recent_trip_stats(users, trips, AS_OF), "user_id", "total_trips")
    assert stats == {"new": 3, "none": 0, "undated": 1}
    ranked = {r.user_id: r for r in transport.user_transport_patterns(users, trips, AS_OF).collect()}
    assert set(ranked) == {"new", "undated"}
    assert ranked["new"].transport_modes_used == "bus, car"
    assert (ranked["new"].co2e_rank, float(ranked["new"].co2e_percentile)) == (1, 100.0)
    in_range = transport.user_transport_patterns_range(users, trips, DateRange.of("2024-01-01", AS_OF)).collect()
    assert {r.user_id for r in in_range} == {"new", "boss"}


def test_type_summary_fan_out(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic"), ("c", "Shed", 50, "Storage")])
    e = energy_frame(spark, [(str(i), "b", "2024-06-15", "gas", 10) for i in range(3)])
    fan = by(buildings.building_type_summary(b, e, AS_OF), "primary_use", "building_count")
    area = by(buildings.building_type_summary(b, e, AS_OF), "primary_use", "total_sq_footage")
    assert fan == {"Academic": 3, "Storage": 1} and area == {"Academic": 300, "Storage": 50}
    once = by(buildings.building_type_summary_dedup(b, e, AS_OF), "primary_use", "total_sq_footage")
    assert once == {"Academic": 100, "Storage": 50}


def test_empty_buildings_stay(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic"), ("c", "Shed", 50, "Storage")])
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10)])
    assert by(buildings.building_performance(b, e), "building_id", "total_co2e")["c"] == 0
    summary = energy.energy_summary_by_building(b, e, DateRange.of("2024-06-01", AS_OF), AS_OF).collect()
    assert [r.building_id for r in summary] == ["b", "c"] and summary[1].total_co2e_emitted is None
    ranked = buildings.building_performance_ranked(b, e, AS_OF)
    assert by(ranked, "building_id", "emission_rank") == {"b": 1, "c": 2}


def test_ratings_of_four_buildings(spark):
    b = building_frame(spark, [(str(i), f"Hall {i}", 1000, "Academic") for i in range(1, 5)])
    e = energy_frame(spark, [(str(i), str(i), "2024-06-15", "electricity", 1000 * i) for i in range(1, 5)])
    efficiency = buildings.building_efficiency(b, e, AS_OF)
    assert by(efficiency, "building_id", "efficiency_rating") == {
        "1": "Excellent", "2": "Good", "3": "Average", "4": "Needs Improvement"
    }
    assert by(efficiency, "building_id", "consumption_variability")["1"] is None
    inverted = by(buildings.building_performance_ranked(b, e, AS_OF), "building_id", "efficiency_rating")
    assert inverted == {"4": "Excellent", "3": "Excellent", "2": "Good", "1": "Average"}
    lowest = buildings.building_performance_ranked(b, e, AS_OF, highest_first=False)
    assert by(lowest, "building_id", "efficiency_rating")["1"] == "Excellent"


def test_single_entity_forms(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic"), ("c", "Shed", 50, "Storage")])
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10), ("2", "c", "2024-06-15", "gas", 30)])
    assert by(buildings.building_recent(b, e, AS_OF, building_id="c"), "building_id", "total_consumption_kwh") == {"c": 30}
    assert by(buildings.building_source_mix(e, AS_OF, building_id="b"), "source", "record_count") == {"gas": 1}
    assert one(energy.peak_hours(b, e, AS_OF, building_id="b"), "peak_hour") == "0:00"
    assert energy.energy_trends(e, DateRange.of("2024-06-01", AS_OF), AS_OF, "daily", building_id="b").count() == 1
    with pytest.raises(ValueError):
        energy.energy_trends(e, DateRange.of("2024-06-01", AS_OF), AS_OF, "yearly")
    users = user_frame(spark, [("u", "user", "X"), ("v", "user", "Y")])
    trips = trip_frame(spark, [("1", "u", "2024-06-03", "car", 10), ("2", "v", "2024-06-04", "car", 30)])
    assert one(transport.personal_footprint(users, trips, AS_OF, user_id="u"), "total_trips") == 1
    versus = transport.user_vs_campus_average(users, trips, AS_OF, user_id="v")
    assert float(one(versus, "percentage_vs_average")) == 50.0
    assert one(transport.trip_listing(trips, "v"), "trip_id") == "2"
    assert transport.user_directory(users, "u").count() == 1
    assert "password_hash" not in transport.user_directory(users).columns
    assert one(transport.personal_weekly_trend(trips, AS_OF, user_id="u"), "week") == dt.datetime(2024, 6, 3)


def test_daily_summary_without_rows(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10)])
    t = trip_frame(spark, [("1", "u", "2024-06-15", "car", 10)])
    row = daily.daily_summary(e, t, "1990-01-01").first()
    assert float(row.total_co2e_kg) == 0 and row.day_over_day_change is None and row.vs_monthly_average is None
    assert (row.active_buildings, row.active_users) == (0, 0)
    assert daily.realtime_snapshot(e, t, "2024-06-16").first().change_percent == Decimal("-100.0")


def test_mean_day_with_and_without_today(spark):
    days = {"2024-06-28": 10000, "2024-06-29": 20000, "2024-06-30": 60000}
    e = energy_frame(spark, [(d, "b", d, "electricity", k) for d, k in days.items()])
    t = trip_frame(spark, [("1", "u", "2024-06-30", "walk", 10)])
    assert float(one(daily.daily_dashboard(e, t, AS_OF), "monthly_avg_co2e_kg")) == 12.0
    assert float(one(daily.daily_summary(e, t, AS_OF), "monthly_average")) == 6.0


def test_scope_without_rows(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 1000)])
    t = trip_frame(spark, [("1", "u", "1990-01-01", "car", 10)])
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    rows = {r.data_source: r for r in overview.scope_breakdown_range(e, t, DateRange.of("2024-01-01", AS_OF)).collect()}
    assert rows["transportation"].total_co2e_kg is None and rows["transportation"].percentage is None
    assert float(rows["energy"].percentage) == 100.0
    summary = overview.carbon_footprint_summary(b, e, t, DateRange.of("2024-01-01", AS_OF)).first()
    assert float(summary.total_co2e_kg) == 0.2 and summary.top_emitting_building == "Hall"
    nothing = overview.carbon_footprint_summary(b, e, t, DateRange.of("1980-01-01", "1980-02-01")).first()
    assert nothing.top_emitting_building == "N/A" and nothing.total_buildings == 0


def test_initiatives(spark):
    users = user_frame(spark, [("u", "admin", "X")])
    rows = [
        ("a", "15.5", "12.3", "completed", "2024-01-15", "2024-06-30", "u"),
        ("b", "45.2", "0", "active", "2024-06-01", None, "u"),
        ("c", None, "1", "planned", "2024-06-01", None, None),
        ("d", "5.2", "5.2", "completed", "2024-03-01", None, "gone"),
        ("e", "1", "0", "cancelled", None, None, "u"),
    ]
    i = initiative_frame(spark, rows)
    got = {r.initiative_id: r for r in initiatives.initiative_effectiveness(i, users, AS_OF).collect()}
    assert (got["a"].planned_duration_days, got["a"].actual_duration_days) == (167, 167)
    assert (got["b"].planned_duration_days, got["b"].actual_duration_days) == (None, 29)
    assert got["d"].actual_duration_days is None and got["d"].created_by_name is None
    order = [r.initiative_id for r in initiatives.initiative_effectiveness(i, users, AS_OF).collect()]
    assert order == ["b", "d", "a", "c", "e"]
    listed = [r.initiative_id for r in initiatives.initiative_listing(i, users).collect()]
    assert listed == ["b", "c", "d", "a", "e"]
    assert {r.created_by_email for r in initiatives.initiative_listing(i, users).collect()} == {None}
    seen = by(initiatives.initiative_listing(i, users, role="admin"), "initiative_id", "created_by_email")
    assert seen["a"] == "u@example.edu"
    assert initiatives.initiative_rows(i, users, initiative_id="a").count() == 1


def test_pages(spark):
    df = spark.range(101)
    info = paging.page_info(df, Page(6, 20)).first()
    assert (info.total_records, info.total_pages, info.has_next, info.has_prev) == (101, 6, False, True)
    assert [r.id for r in paging.page_of(df, [F.col("id")], Page(6, 20)).collect()] == [100]
    seen, last = [], (1000,)
    while rows := paging.page_after(df, ["id"], last, 20).collect():
        seen += [r.id for r in rows]
        last = (seen[-1],)
    assert seen == list(range(100, -1, -1))


def test_pages_per_key(spark):
    df = spark.range(60).selectExpr("id", "CASE WHEN id < 40 THEN 'hot' ELSE CAST(id % 7 AS STRING) END AS k")
    got = paging.page_per_key(df, ["k"], [F.col("id").desc()], Page(2, 3))
    assert sorted(r.id for r in got.filter("k = 'hot'").collect()) == [34, 35, 36]


def test_visibility(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10), ("2", "b", "2024-01-15", "gas", 10)])
    assert predicates.visible_readings(e, "admin", AS_OF).count() == 2
    assert predicates.visible_readings(e, None, AS_OF).count() == 1
    t = trip_frame(spark, [("1", "u", "2024-06-03", "car", 10), ("2", "v", "2024-06-04", "car", 30)])
    assert predicates.own_trips(t, "user", "u").count() == 1
    assert predicates.own_trips(t, None, None).count() == 0


def test_schema_check(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10)])
    assert check_schema(e, "energy_consumption") is e
    with pytest.raises(ValueError, match="date_time is missing"):
        check_schema(e.drop("date_time"), "energy_consumption")
    with pytest.raises(ValueError, match="consumption_kwh is double"):
        check_schema(e.withColumn("consumption_kwh", F.lit(1.0)), "energy_consumption")


def test_dashboards_are_complete(spark):
    t = Ledger(
        buildings=building_frame(spark, [("b", "Hall", 100, "Academic")]),
        users=user_frame(spark, [("u", "user", "X")]),
        energy=energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10)]),
        trips=trip_frame(spark, [("1", "u", "2024-06-03", "car", 10)]),
        initiatives=initiative_frame(spark, [("a", "1", "1", "active", "2024-01-15", None, "u")]),
    )
    assert all(f.count() > 0 for f in overview.public_dashboard(t, AS_OF).values())
    assert all(f.count() > 0 for f in overview.admin_dashboard(t, DateRange.last_days(AS_OF, 30)).values())


# --- pages ----------------------------------------------------------------------------------
def test_any_page_of_a_listing_is_that_of_the_sorted_rows(spark):
    """Hot days and seconds, missing times, ties, keys that are unknown; located at every depth."""
    rows = [(i, i % 7, None if i % 50 == 0 else dt.datetime(2024, 1, 1 + (0 if i % 3 else i % 28), 5, 0, 0 if i % 2 else i % 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id INT, owner INT, at TIMESTAMP_NTZ").repartition(5)
    owners = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 3, 9)], "owner INT")
    order = [F.col("id").desc_nulls_last()]
    for keys, key, kept in ((None, None, rows), (owners, "owner", [r for r in rows if r[1] < 4])):
        newest = sorted(kept, key=lambda r: (r[2] is None, r[2] or dt.datetime.min, r[0]), reverse=True)
        for size, number in ((20, 1), (20, 3), (20, 4), (50, 17), (100, 12), (7, 150), (100, 15), (100, 18), (100, 40)):
            page = Page(number, size)
            got = paging.page_at(df, "at", order, page, keys, key, shallow=0, most=100).collect()
            assert [r.id for r in got] == [r[0] for r in newest[page.offset : page.offset + size]], (number, size)
    dated = df.withColumn("at", F.col("at").cast("date"))
    got = [r.id for r in paging.page_at(dated, "at", order, Page(12, 100), shallow=0, most=100).collect()]
    days = sorted(rows, key=lambda r: (r[2] is None, r[2].date() if r[2] else dt.date.min, r[0]), reverse=True)
    assert got == [r[0] for r in days[1100:1200]]


def test_a_listing_joins_its_page_alone(spark, small):
    t = ledger(spark, small)
    page = energy.energy_listing(t.buildings, t.energy, "2001-06-30", Page(2, 50), role="admin", tie_break=("record_id", "building_id"))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert join < plan.index("GlobalLimit") and "LeftSemi" in plan[join:]


def test_an_admin_listing_of_trips_joins_its_page_alone(spark, small):
    t = ledger(spark, small)
    page = transport.trip_listing_admin(t.users, t.trips, Page(2, 50))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("GlobalLimit")
    got = [(r.date, r.trip_id) for r in page.collect()]
    every = transport.trip_listing_admin(t.users, t.trips, Page(1, 100)).collect()
    assert got == [(r.date, r.trip_id) for r in every[50:]] and len(got) == 50
