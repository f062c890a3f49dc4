import datetime as dt

import pytest
from pyspark.sql import functions as F

from cinderbook.operators.quality import accepted, check_readings
from cinderbook.sources.binding import GIVEN, buildings, energy, live_readings, read
from cinderbook.streaming import ingest, rollups
from tests.conftest import building_frame, energy_frame

SCHEMA = (
    "record_id STRING, building_id STRING, date_time TIMESTAMP_NTZ, source STRING, consumption_kwh DECIMAL(10,2)"
)


def write_batch(spark, folder, rows):
    df = energy_frame(spark, rows).select("record_id", "building_id", "date_time", "source", "consumption_kwh")
    df.coalesce(1).write.mode("append").parquet(folder)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_rollup_equals_batch(spark, small, tmp_path):
    stream = rollups.stream_table(spark, small, GIVEN["events"], pathGlobFilter="events.parquet")
    run(rollups.start_rollup(live_readings(stream), rollups.DAILY, str(tmp_path)))
    got = {r.period: r.record_count for r in rollups.windows(spark, str(tmp_path), rollups.DAILY).collect()}
    batch = live_readings(read(spark, small, "events")).groupBy(F.to_date("date_time").alias("d")).count()
    assert {k.date(): v for k, v in got.items()} == {r.d: r["count"] for r in batch.collect()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_windows_do_not_depend_on_the_session_zone(spark, tmp_path, zone):
    folder = str(tmp_path / "in")
    write_batch(spark, folder, [("1", "b", "2024-06-01 23:30:00", "gas", 10), ("2", "b", "2024-06-02 00:30:00", "gas", 10)])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        run(rollups.start_rollup(rollups.stream_table(spark, folder, SCHEMA), rollups.DAILY, str(tmp_path / "out")))
        got = {r.period for r in rollups.windows(spark, str(tmp_path / "out"), rollups.DAILY).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 2)}


def by_day(df):
    return {r.period.day: float(r.total_consumption_kwh) for r in df.collect()}


def test_windows_grow_over_runs_and_late_rows_are_kept(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = lambda: run(rollups.start_rollup(rollups.stream_table(spark, folder, SCHEMA), rollups.DAILY, out))
    write_batch(spark, folder, [("1", "b", "2024-06-01 10:00:00", "gas", 10), ("2", "b", "2024-06-09 10:00:00", "gas", 10)])
    start()
    # One row for the day still open, one far older than the watermark.
    write_batch(spark, folder, [("3", "b", "2024-06-09 12:00:00", "gas", 30), ("4", "b", "2024-06-01 12:00:00", "gas", 99)])
    start()
    write_batch(spark, folder, [("5", "b", "2024-06-20 10:00:00", "gas", 5), ("6", "b", None, "gas", 7)])
    start()
    assert by_day(rollups.windows(spark, out, rollups.DAILY, late=False)) == {1: 10.0, 9: 40.0, 20: 5.0}
    assert [(r.record_id, r.batch) for r in rollups.late_readings(spark, out).collect()] == [("4", 1)]
    whole = {1: 109.0, 9: 40.0, 20: 5.0}
    assert by_day(rollups.windows(spark, out, rollups.DAILY)) == whole
    assert by_day(rollups.closed_windows(spark, out, rollups.DAILY)) == {1: 109.0, 9: 40.0}
    # Merging is repeatable; a version and the batches after it make the same windows as one run over everything.
    assert rollups.merge_late(spark, out, rollups.DAILY) == rollups.merge_late(spark, out, rollups.DAILY) == 2
    assert by_day(rollups.windows(spark, out, rollups.DAILY, late=False)) == whole
    write_batch(spark, folder, [("7", "b", "2024-06-09 13:00:00", "gas", 1), ("8", "b", "2024-06-20 13:00:00", "gas", 2)])
    start()
    assert by_day(rollups.windows(spark, out, rollups.DAILY, late=False)) == {1: 109.0, 9: 40.0, 20: 7.0}
    once = rollups.totals(spark.read.schema(SCHEMA).parquet(folder), rollups.DAILY)
    assert by_day(rollups.windows(spark, out, rollups.DAILY)) == by_day(once) == {1: 109.0, 9: 41.0, 20: 7.0}
    rollups.merge_late(spark, out, rollups.DAILY)
    assert sorted(rollups.windows(spark, out, rollups.DAILY).collect()) == sorted(once.collect())


def test_a_repeated_batch_replaces_its_own_output(spark, tmp_path):
    """The log of the last batch is lost after its output was written: the batch runs again."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = lambda: run(rollups.start_rollup(rollups.stream_table(spark, folder, SCHEMA), rollups.HOURLY, out))
    write_batch(spark, folder, [("1", "b", "2024-06-09 10:00:00", "gas", 10)])
    start()
    write_batch(spark, folder, [("2", "b", "2024-06-09 10:30:00", "gas", 5), ("3", "c", "2024-06-01 10:30:00", "gas", 4)])
    start()
    before = sorted(rollups.windows(spark, out, rollups.HOURLY).collect())
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    start()
    assert sorted(rollups.windows(spark, out, rollups.HOURLY).collect()) == before
    assert rollups.late_readings(spark, out).count() == 1


def ingested(stream, target, b, tmp_path):
    for query in ingest.start_ingest(stream, target, b, str(tmp_path / "out"), dt.datetime(2024, 7, 1)):
        run(query)


def test_ingest_equals_batch(spark, small, tmp_path):
    b = building_frame(spark, [("6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5b", "Hall", 100, "Academic")])
    target = energy_frame(spark, [("0", "b", "2024-06-15", "gas", 10)])
    raw = [
        ("1", "6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5b", "2024-06-15", "gas", "10"),
        ("2", "6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5c", "2024-06-15", "gas", "10"),
        ("3", "b", "2024-06-15", "gas", "10"),
    ]
    schema = "record_id STRING, building_id STRING, date_time STRING, source STRING, consumption_kwh STRING"
    spark.createDataFrame(raw, schema).write.json(str(tmp_path / "in"))
    stream = rollups.stream_table(spark, str(tmp_path / "in"), schema, fmt="json")
    ingested(stream, target, b, tmp_path)
    good = spark.read.parquet(str(tmp_path / "out" / "readings")).collect()
    assert [r.record_id for r in good] == ["1"] and float(good[0].co2e_emitted) == 0.002
    refused = {r.record_id: r.reason for r in spark.read.parquet(str(tmp_path / "out" / "refused")).collect()}
    assert refused == {"2": "unknown building_id", "3": "building_id is malformed"}
    batch = check_readings(spark.createDataFrame(raw, schema))
    assert accepted(batch).count() == 2
    assert buildings(spark, small).count() and energy(spark, small).count()


HALL = "6f1c2a34-5b6d-4e7f-8a9b-0c1d2e3f4a5b"
RAW = "record_id STRING, building_id STRING, date_time STRING, source STRING, consumption_kwh STRING"


def test_ingest_refuses_keys_of_earlier_batches(spark, tmp_path):
    b = building_frame(spark, [(HALL, "Hall", 100, "Academic")])
    target = energy_frame(spark, [("0", HALL, "2024-06-15", "gas", 10)])

    def send(*rows):
        raw = [(key, HALL, "2024-06-15", "gas", kwh) for key, kwh in rows]
        spark.createDataFrame(raw, RAW).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ingested(rollups.stream_table(spark, str(tmp_path / "in"), RAW, fmt="json"), target, b, tmp_path)

    def read(name):
        return sorted((r.record_id, *r[1:2]) for r in spark.read.parquet(str(tmp_path / "out" / name)).collect())

    send(("5", "10"), ("6", "1"), ("6", "2"), ("0", "3"))
    send(("5", "20"), ("7", "4"), (None, "8"))
    send(("5", "20"), ("7", "4"), ("6", "9"), (None, "8"), ("8", "1e9"))
    good = spark.read.parquet(str(tmp_path / "out" / "readings"))
    kept = {r.record_id: float(r.consumption_kwh) for r in good.collect()}
    made = [k for k in kept if len(k) > 5]
    assert {k: v for k, v in kept.items() if k not in made} == {"5": 10.0, "6": 2.0, "7": 4.0}
    assert len(made) == 2 and {kept[k] for k in made} == {8.0} and good.count() == 5
    refused = [("0", "record_id exists"), ("5", "record_id exists"), ("5", "record_id exists"), ("6", "record_id exists"),
               ("6", "record_id repeated in the batch"), ("7", "record_id exists"), ("8", "consumption_kwh must be 0 to 1000000")]
    assert read("refused") == refused
    # A batch that runs again after a failure knows which keys were its own.
    before = sorted(good.collect())
    for part in ("keyed", "rest"):
        for name in ("2", ".2.crc"):
            (tmp_path / "out" / part / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    ingested(rollups.stream_table(spark, str(tmp_path / "in"), RAW, fmt="json"), target, b, tmp_path)
    assert sorted(spark.read.parquet(str(tmp_path / "out" / "readings")).collect()) == before and read("refused") == refused
