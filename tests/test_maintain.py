import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cinderbook.operators import integrity, maintain, quality
from cinderbook.operators.sizes import broadcast_if_small
from cinderbook.schemas import Ledger
from tests.conftest import building_frame, energy_frame, initiative_frame, trip_frame, user_frame

NOW = dt.datetime(2024, 7, 1, 9)


def reasons(change, key):
    return {r[key]: r.reason for r in change.refused.collect()}


def table(change, key):
    return {r[key]: r for r in change.table.collect()}


def updates(df, stamp="2024-07-01 00:00:00"):
    return df.withColumn("updated_at", F.lit(stamp).cast("timestamp_ntz")).drop("co2e_emitted", "created_at")


def test_append_readings_gives_keys_times_and_emission(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 10)])
    batch = energy_frame(spark, [(None, "b", "2024-06-16", "electricity", 100)] * 2 + [("9", "x", "2024-06-16", "gas", 1)])
    change = maintain.append_readings(e, b, batch.drop("co2e_emitted", "created_at"), NOW)
    new = change.applied.collect()
    assert len(new) == 2 and len({r.record_id for r in new}) == 2 and None not in {r.record_id for r in new}
    assert {r.co2e_emitted for r in new} == {Decimal("0.0400")} and {r.created_at for r in new} == {NOW}
    assert change.table.count() == 3 and change.table.columns == e.columns
    assert reasons(change, "record_id") == {"9": "unknown building_id"}


def test_append_unique(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    names = [("n1", "Hall"), ("n2", "New"), ("n3", "New"), ("n4", "Other")]
    batch = building_frame(spark, [(k, n, 10, "Academic") for k, n in names])
    change = maintain.append_unique(b, batch, "building_id", "name", NOW)
    assert set(table(change, "building_id")) == {"b", "n2", "n4"}
    assert reasons(change, "building_id") == {"n1": "name exists", "n3": "name repeated in the batch"}


def test_append_initiatives_by_role(spark):
    users = user_frame(spark, [("boss", "admin", "X"), ("u", "user", "X")])
    i = initiative_frame(spark, [("a", "1", "1", "active", "2024-01-15", None, "u")])
    sent = [("p", "5", None, "active", "2024-01-15", None, "boss"), ("q", "5", None, "active", None, None, "u"),
            ("r", "5", None, None, None, None, "boss"), ("s", "5", None, "active", None, None, "gone")]
    change = maintain.append_initiatives(i, users, initiative_frame(spark, sent).drop("created_at"), NOW)
    got = table(change, "initiative_id")
    assert {k: r.status for k, r in got.items()} == {"a": "active", "p": "active", "q": "planned", "r": "planned"}
    assert got["p"].actual_reduction_tco2e == 0 and got["p"].created_at == NOW
    assert reasons(change, "initiative_id") == {"s": "unknown submitter"}


def test_update_recomputes_and_is_idempotent(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "electricity", 100), ("2", "b", "2024-06-15", "gas", 100)])
    sent = updates(energy_frame(spark, [("1", "b", "2024-06-15", "electricity", 200), ("7", "b", "2024-06-15", "gas", 1)]))
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    first = maintain.update_readings(e, b, sent)
    got = table(first, "record_id")
    assert got["1"].co2e_emitted == Decimal("0.0800") and got["2"].co2e_emitted == Decimal("0.0200")
    assert reasons(first, "record_id") == {"7": "not found"}
    assert [r.record_id for r in first.applied.collect()] == ["1"]
    again = maintain.update_readings(first.table, b, sent)
    assert sorted(again.table.collect()) == sorted(first.table.collect())


def test_latest_update_wins(spark):
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 1)])
    old = updates(energy_frame(spark, [("1", "b", "2024-06-15", "gas", 900)]), "2024-07-01 00:00:00")
    new = updates(energy_frame(spark, [("1", "b", "2024-06-15", "gas", 5)]), "2024-07-02 00:00:00")
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    for batch in (old.unionByName(new), new.unionByName(old)):
        assert table(maintain.update_readings(e, b, batch), "record_id")["1"].consumption_kwh == 5


def test_only_the_owner_updates_a_trip(spark):
    t = trip_frame(spark, [("1", "u", "2024-06-15", "car", 10), ("2", "v", "2024-06-15", "car", 10)])
    sent = updates(trip_frame(spark, [("1", "u", "2024-06-16", "bus", 20), ("2", "u", "2024-06-16", "bus", 20)]))
    change = maintain.update_trips(t, sent)
    got = table(change, "trip_id")
    assert got["1"].mode == "bus" and got["1"].co2e_emitted == Decimal("1.6000") and got["2"].mode == "car"
    assert reasons(change, "trip_id") == {"2": "not the owner"}


def test_building_names_stay_unique(spark):
    b = building_frame(spark, [("a", "AA", 1, "XX"), ("b", "BB", 1, "XX"), ("c", "CC", 1, "XX"), ("d", "DD", 1, "XX")])
    # a keeps its name, b asks for a's name, c and d ask for the same free one.
    sent = building_frame(spark, [("a", "AA", 2, "YY"), ("b", "AA", 2, "YY"), ("c", "NN", 2, "YY"), ("d", "NN", 2, "YY"),
                                  ("z", "ZZ", 2, "YY")])
    sent = sent.drop("created_at", "updated_at").withColumn("sent_at", F.lit(NOW))
    change = maintain.update_buildings(b, sent, NOW)
    got = table(change, "building_id")
    assert {k: (r.name, r.sq_footage) for k, r in got.items()} == {
        "a": ("AA", 2), "b": ("BB", 1), "c": ("NN", 2), "d": ("DD", 1)
    }
    assert got["a"].updated_at == NOW and got["b"].updated_at is None
    assert reasons(change, "building_id") == {"b": "name exists", "d": "name exists", "z": "not found"}


def test_updates_keep_the_rules_of_new_rows(spark):
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    e = energy_frame(spark, [("1", "b", "2024-06-15", "gas", 1), ("2", "b", "2024-06-15", "gas", 1)])
    sent = [("1", "77", "2024-06-16", "gas", 2), ("1", "b", "2024-06-16", "plasma", -5), ("2", "b", "2024-06-16", "fuel", 3),
            ("2", "b", None, "fuel", 4), ("9", "b", "2024-06-16", "gas", 5)]
    change = maintain.update_readings(e, b, updates(energy_frame(spark, sent)))
    got = table(change, "record_id")
    assert float(got["1"].consumption_kwh) == 1 and (got["2"].source, float(got["2"].consumption_kwh)) == ("fuel", 3.0)
    refused = sorted((r.record_id, r.reason) for r in change.refused.collect())
    assert refused == [("1", "source is unknown; consumption_kwh must be 0 to 1000000"), ("1", "unknown building_id"),
                       ("2", "date_time must be an ISO time"), ("9", "not found")]
    t = trip_frame(spark, [("1", "u", "2024-06-15", "car", 10)])
    change = maintain.update_trips(t, updates(trip_frame(spark, [("1", "u", "2024-06-16", "rocket", 20)])))
    assert reasons(change, "trip_id") == {"1": "mode is unknown"} and change.applied.count() == 0
    i = initiative_frame(spark, [("a", "5", "1", "active", "2024-01-15", None, None)])
    worse = i.withColumns({"name": F.lit("new name"), "end_date": F.lit("2023-01-01").cast("date"), "actual_reduction_tco2e": F.lit(-1).cast("decimal(10,2)"),
                           "status": F.lit(None).cast("string"), "sent_at": F.lit(NOW)}).drop("created_at", "updated_at", "created_by")
    change = maintain.update_initiatives(i, worse, NOW)
    assert reasons(change, "initiative_id") == {"a": "end_date must not be before start_date; actual_reduction_tco2e must be a non-negative number; status is missing"}
    u = user_frame(spark, [("u", "user", "X")])
    change = maintain.update_users(u, u.withColumns({"first_name": F.lit(" A "), "last_name": F.lit("Byron"), "sent_at": F.lit(NOW)}).drop("created_at", "updated_at", "role", "email"), NOW)
    assert reasons(change, "user_id") == {"u": "first_name must have 2 to 50 characters"}
    placed = b.withColumns({"location_gps": F.struct(F.lit(1.5).alias("x"), F.lit(-7.0).alias("y")), "sent_at": F.lit(NOW)}).drop("created_at", "updated_at")
    got = table(maintain.update_buildings(b, placed, NOW), "building_id")["b"]
    assert (got.location_gps.x, got.location_gps.y, got.updated_at) == (1.5, -7.0, NOW)
    change = maintain.update_buildings(b, placed.withColumn("sq_footage", F.lit(0)), NOW)
    assert reasons(change, "building_id") == {"b": "sq_footage must be a whole number from 1 to 10000000"}


def test_patch_keeps_what_is_not_given(spark):
    i = initiative_frame(spark, [("a", "5", "1", "active", None, None, None), ("b", "5", "2", "active", None, None, None)])
    raw = spark.createDataFrame(
        [("a", "4.5", None), ("b", None, "completed"), ("c", "-1", None), ("d", None, None), ("e", "x", "lost")],
        "initiative_id STRING, actual_reduction_tco2e STRING, status STRING",
    ).withColumn("sent_at", F.lit(NOW))
    checked = quality.check_progress(raw)
    assert {r.initiative_id: len(r.errors) for r in checked.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}
    got = table(maintain.patch_initiative_progress(i, quality.accepted(checked), NOW), "initiative_id")
    assert (got["a"].actual_reduction_tco2e, got["a"].status) == (Decimal("4.50"), "active")
    assert (got["b"].actual_reduction_tco2e, got["b"].status) == (Decimal("2.00"), "completed")


def test_deletes(spark):
    b = building_frame(spark, [("a", "A", 1, "X"), ("b", "B", 1, "X")])
    e = energy_frame(spark, [("1", "a", "2024-06-15", "gas", 1), ("2", "gone", "2024-06-15", "gas", 1)])
    keys = spark.createDataFrame([("a",), ("b",), ("z",), ("gone",)], "building_id STRING")
    guarded = maintain.delete_buildings_guarded(b, e, keys)
    assert set(table(guarded, "building_id")) == {"a"}
    assert reasons(guarded, "building_id") == {"a": "has readings", "z": "not found", "gone": "not found"}
    change, left = maintain.delete_buildings_cascade(b, e, keys)
    assert change.table.count() == 0 and [r.record_id for r in left.collect()] == ["2"]
    t = trip_frame(spark, [("1", "u", "2024-06-15", "car", 10), ("2", "v", "2024-06-15", "car", 10)])
    own = spark.createDataFrame([("1", "u"), ("2", "u")], "trip_id STRING, user_id STRING")
    trips = maintain.delete_rows(t, own, ["trip_id", "user_id"])
    assert set(table(trips, "trip_id")) == {"2"} and trips.refused.count() == 1
    users = user_frame(spark, [("u", "user", "X"), ("v", "user", "X")])
    i = initiative_frame(spark, [("a", "5", "1", "active", None, None, "u"), ("b", "5", "2", "active", None, None, "v")])
    gone = spark.createDataFrame([("u",)], "user_id STRING")
    change, trips, kept = maintain.delete_users_cascade(users, t, i, gone)
    assert [r.trip_id for r in trips.collect()] == ["2"]
    assert {r.initiative_id: r.created_by for r in kept.collect()} == {"a": None, "b": "v"}


def test_large_batches_are_not_broadcast(spark):
    df = spark.range(50)
    assert "ResolvedHint" in broadcast_if_small(df, rows=50)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, rows=49)._jdf.queryExecution().analyzed().toString()


def test_hot_keys_in_a_batch(spark):
    """A third of the batch asks for one name, another third corrects one record."""
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    batch = spark.range(3000).selectExpr(
        "CAST(id AS STRING) AS building_id",
        "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('Hall ', id) END AS name",
        "10 AS sq_footage",
        "'Academic' AS primary_use",
    )
    change = maintain.append_unique(b, batch, "building_id", "name", NOW)
    assert change.applied.count() == 2001 and change.refused.count() == 999
    e = energy_frame(spark, [("0", "b", "2024-06-15", "gas", 1), ("1", "b", "2024-06-15", "gas", 1)])
    sent = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN '0' ELSE CAST(id AS STRING) END AS record_id",
        "'b' AS building_id",
        "TIMESTAMP_NTZ'2024-06-15 00:00:00' AS date_time",
        "'gas' AS source",
        "CAST(id AS DECIMAL(10,2)) AS consumption_kwh",
        "TIMESTAMP_NTZ'2024-06-15 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS updated_at",
    )
    got = table(maintain.update_readings(e, b, sent), "record_id")
    assert (got["0"].consumption_kwh, got["1"].consumption_kwh) == (2997, 1)


def test_constraints(spark):
    ledger = Ledger(
        buildings=building_frame(spark, [("a", "A", 0, "X"), ("b", "A", 1, None)]),
        users=user_frame(spark, [("u", "boss", "X"), (None, "user", "X")]),
        energy=energy_frame(spark, [("1", "x", "2024-06-15", "wind", -1), ("1", "a", "2024-06-15", "gas", 1)]),
        trips=trip_frame(spark, [("1", "u", None, "car", 1)]),
        initiatives=initiative_frame(spark, [("a", "-5", None, "active", "2024-06-15", "2024-01-01", "w")]),
    )
    found = {(r.table_name, r.rule): r.violations for r in integrity.table_violations(ledger).collect() if r.violations}
    assert found == {
        ("buildings", "primary_use not null"): 1,
        ("buildings", "sq_footage > 0"): 1,
        ("buildings", "name unique"): 1,
        ("users", "user_id not null"): 1,
        ("users", "email not null"): 1,
        ("users", "first_name not null"): 1,
        ("users", "role in set"): 1,
        ("energy_consumption", "source in set"): 1,
        ("energy_consumption", "consumption_kwh >= 0"): 1,
        ("energy_consumption", "record_id unique"): 1,
        ("energy_consumption", "building_id references buildings"): 1,
        ("transportation_log", "date not null"): 1,
        ("initiatives", "target_reduction_tco2e >= 0"): 1,
        ("initiatives", "end_date >= start_date"): 1,
        ("initiatives", "created_by references users"): 1,
    }
