import datetime as dt

import pytest

from cinderbook.operators import maintain
from cinderbook.operators.predicates import between_days
from cinderbook.sources.versions import VersionedFact
from tests.conftest import building_frame, energy_frame
from tests.test_maintain import updates


def days(month, start):
    return [(str(start + d), "b", f"2024-{month:02d}-{d + 1:02d} 08:00:00", "gas", 10) for d in range(25)]


@pytest.fixture
def fact(spark, tmp_path):
    made = VersionedFact(spark, str(tmp_path / "fact"), "energy_consumption")
    made.create(energy_frame(spark, [r for m in range(1, 7) for r in days(m, 100 * m)]))
    return made


def size(tmp_path, version):
    return sum(p.stat().st_size for p in (tmp_path / "fact" / "data" / f"v={version}").rglob("*.parquet"))


def by_key(df):
    return {r.record_id: (r.date_time, float(r.consumption_kwh)) for r in df.collect()}


def test_only_touched_months_are_written(spark, fact, tmp_path):
    b = building_frame(spark, [("b", "Hall", 100, "Academic")])
    # One reading changes, one moves from April to June, one is unknown.
    sent = [("203", "b", "2024-02-04 09:00:00", "gas", 99), ("401", "b", "2024-06-30 09:00:00", "gas", 7), ("9", "b", "2024-05-01 00:00:00", "gas", 1)]
    batch = updates(energy_frame(spark, sent))
    before = by_key(fact.read())
    change = fact.change(batch, ["record_id"], lambda t: maintain.update_readings(t, b, batch))
    assert {r.record_id: r.reason for r in change.refused.collect()} == {"9": "not found"}
    whole = maintain.update_readings(fact.read(0).drop("month"), b, batch)
    assert by_key(fact.read()) == by_key(whole.table) and by_key(fact.read(0)) == before
    months = [m for v, m in fact.folders() if v == 1]
    assert months == ["2024-02-01", "2024-04-01", "2024-06-01"] and len(fact.folders()) == 7
    # Two months of six are written, and the one row that moved.
    assert size(tmp_path, 1) < 0.6 * size(tmp_path, 0)
    june = between_days(fact.read(), "date_time", "2024-06-01", "2024-06-30")
    assert june.count() == 26
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan


def test_appends_rewrite_nothing_and_deletes_their_months(spark, fact, tmp_path):
    assert fact.append(energy_frame(spark, [("900", "b", "2024-03-28 08:00:00", "gas", 1), ("901", "b", "2025-01-01 08:00:00", "gas", 1)])) == 1
    assert size(tmp_path, 1) < size(tmp_path, 0) and len(fact.folders()) == 8 and fact.read().count() == 152
    keys = spark.createDataFrame([("900",), ("302",), ("nothing",)], "record_id STRING")
    change = fact.change(keys, ["record_id"], lambda t: maintain.delete_rows(t, keys, ["record_id"]))
    assert [r.record_id for r in change.refused.collect()] == ["nothing"]
    # March was in two folders and is one again.
    assert fact.read().count() == 150 and [v for v, m in fact.folders() if m == "2024-03-01"] == [2]
    unknown = spark.createDataFrame([("nothing",)], "record_id STRING")
    fact.change(unknown, ["record_id"], lambda t: maintain.delete_rows(t, unknown, ["record_id"]))
    assert fact.versions() == [0, 1, 2]
    # The last row of a month goes with its folder.
    keys = spark.createDataFrame([("901",)], "record_id STRING")
    fact.change(keys, ["record_id"], lambda t: maintain.delete_rows(t, keys, ["record_id"]))
    assert fact.read().count() == 149 and "2025-01-01" not in {m for _, m in fact.folders()}
    with pytest.raises(ValueError):
        fact.create(fact.read())


def test_a_version_without_a_manifest_is_not_there(spark, fact, tmp_path):
    fact.append(energy_frame(spark, [("900", "b", "2024-03-28 08:00:00", "gas", 1)]))
    (tmp_path / "fact" / "manifests" / "version=1" / "_SUCCESS").unlink()
    assert fact.versions() == [0] and fact.read().count() == 150
    assert fact.append(energy_frame(spark, [("901", "b", "2024-03-29 08:00:00", "gas", 1)])) == 1
    assert fact.read().where("record_id = '900'").count() == 0 and fact.read().count() == 151
    assert dt.datetime(2024, 3, 29, 8) in {r.date_time for r in fact.read().collect()}
