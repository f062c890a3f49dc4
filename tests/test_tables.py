import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cinderbook.params import DateRange
from cinderbook.operators import maintain
from cinderbook.operators.predicates import between_days
from cinderbook.plans import documents, overview, views
from cinderbook.plans.energy import readings_with_building
from cinderbook.plans.transport import trips_with_user
from cinderbook.schemas import MONTH_COLUMN, Ledger
from cinderbook.sources import tables
from cinderbook.sources.binding import AS_OF, ledger
from tests.conftest import building_frame, energy_frame, initiative_frame, trip_frame, user_frame


@pytest.fixture(scope="module")
def model(spark):
    gps = F.struct(F.lit(40.7).alias("x"), F.lit(-74.0).alias("y"))
    return Ledger(
        buildings=building_frame(spark, [("b", "Hall", 100, "Academic")]).withColumn("location_gps", gps),
        users=user_frame(spark, [("u", "user", "X")]),
        energy=energy_frame(
            spark, [("1", "b", "2024-05-15", "gas", 10), ("2", "b", "2024-06-15 13:00:00", "steam", 20)]
        ),
        trips=trip_frame(spark, [("1", "u", "2024-06-03", "car", 10)]),
        initiatives=initiative_frame(spark, [("a", "1", "1", "active", "2024-01-15", None, "u")]),
    )


NAMES = {
    "buildings": "buildings",
    "users": "users",
    "energy_consumption": "energy",
    "transportation_log": "trips",
    "initiatives": "initiatives",
}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, model, tmp_path, fmt):
    for table, attribute in NAMES.items():
        tables.write_table(getattr(model, attribute), table, str(tmp_path / table), fmt)
    again = tables.read_ledger(spark, str(tmp_path), fmt)
    for attribute in NAMES.values():
        expected = getattr(model, attribute)
        got = getattr(again, attribute).select(*expected.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_append_and_no_overwrite(spark, model, tmp_path):
    path = str(tmp_path / "energy")
    tables.write_table(model.energy, "energy_consumption", path)
    tables.write_table(model.energy, "energy_consumption", path, mode="append")
    assert tables.read_table(spark, "energy_consumption", path).count() == 4
    with pytest.raises(ValueError):
        tables.write_table(model.energy, "energy_consumption", path, mode="overwrite")


def test_dates_prune_months_and_reach_the_scan(spark, model, tmp_path):
    path = str(tmp_path / "energy")
    tables.write_table(model.energy, "energy_consumption", path)
    read = tables.read_table(spark, "energy_consumption", path)
    assert MONTH_COLUMN in read.columns
    june = between_days(read, "date_time", "2024-06-02", "2024-06-30").select("consumption_kwh")
    assert [float(r[0]) for r in june.collect()] == [20.0]
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert f"{MONTH_COLUMN}" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date_time" in plan and "LessThan(date_time" in plan
    assert "ReadSchema: struct<date_time:timestamp_ntz,consumption_kwh:decimal(10,2)>" in plan


def test_changes_to_a_table_read_by_month(spark, model, tmp_path):
    tables.write_table(model.energy, "energy_consumption", str(tmp_path / "v1"))
    read = tables.read_table(spark, "energy_consumption", str(tmp_path / "v1"))
    moved = model.energy.filter("record_id = '1'").withColumn("date_time", F.lit("2024-06-20").cast("timestamp_ntz"))
    moved = moved.withColumn("updated_at", F.col("date_time")).drop("co2e_emitted", "created_at")
    changed = maintain.update_readings(read, model.buildings, moved).table
    assert between_days(changed, "date_time", "2024-06-01", "2024-06-30").count() == 2
    more = model.energy.withColumn("record_id", F.concat("record_id", F.lit("x"))).drop("co2e_emitted", "created_at")
    added = maintain.append_readings(changed, model.buildings, more, dt.datetime(2024, 7, 1)).table
    assert between_days(added, "date_time", "2024-05-01", "2024-05-31").count() == 1
    tables.write_table(added, "energy_consumption", str(tmp_path / "v2"))
    again = tables.read_table(spark, "energy_consumption", str(tmp_path / "v2"))
    assert between_days(again, "date_time", "2024-06-01", "2024-06-30").count() == 3 and again.count() == 4


def test_views(spark, small):
    views.create_views(ledger(spark, small), AS_OF)
    assert spark.sql("SELECT total_buildings FROM campus_overview").first()[0] == 10
    assert spark.sql("SELECT * FROM building_performance ORDER BY total_co2e DESC LIMIT 10").count() == 10
    assert spark.sql("SELECT * FROM user_footprint").count() > 0


def test_documents(spark, model, tmp_path):
    rows = readings_with_building(model.buildings, model.energy, "2024-06-30", role="admin")
    docs = [json.loads(r.document) for r in documents.as_json(documents.reading_documents(rows)).collect()]
    assert {d["building"]["name"] for d in docs} == {"Hall"} and {d["id"] for d in docs} == {"1", "2"}
    trip = documents.trip_documents(trips_with_user(model.users, model.trips)).first()
    assert trip.user.email == "u@example.edu"


def test_carbon_footprint_document_holds_every_item(spark, small, tmp_path):
    t = ledger(spark, small)
    days = DateRange.last_days(AS_OF, 365)
    sections = overview.carbon_footprint(t, days)
    rows = documents.carbon_footprint_document(t, days).collect()
    for name, section in sections.items():
        expected = [json.loads(text) for text in section.toJSON().collect()]
        found = [json.loads(r.document) for r in rows if r.section == name]
        assert sorted(map(str, found)) == sorted(map(str, expected))
    documents.write_sections(sections, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "scopes")).count() == 2
