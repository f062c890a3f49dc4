"""Registered data-quality, maintenance, synthetic-data and streaming jobs."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from decimal import Decimal
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import submissions as given
from checks.queries import MONTH, YEAR, job, query
from cinderbook.functions.factors import with_energy_co2e
from cinderbook.operators import integrity, maintain, quality
from cinderbook.operators.predicates import between_days
from cinderbook.plans import documents, energy, overview, transport
from cinderbook.sources import binding, synth
from cinderbook.schemas import MONTH_COLUMN
from cinderbook.sources.binding import AS_OF, ledger, live_readings, read
from cinderbook.sources.versions import VersionedFact
from cinderbook.streaming import ingest, rollups

LOADED_AT = dt.datetime(2001, 7, 1, 12)
# Keys of the given tables are numbers; a negative one stands for a malformed key.
NUMBER_KEY = r"^\d+$"


def submitted(spark: SparkSession, sf_dir: str, batch) -> DataFrame:
    table, expressions = batch
    df = read(spark, sf_dir, table).selectExpr(*expressions)
    stamps = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = live_readings(read(spark, sf_dir, "events"))
    return with_energy_co2e(readings).withColumn("created_at", F.col("date_time"))


def reasons(change: maintain.Change, key: str) -> DataFrame:
    return change.refused.select(key, "reason")


# --- row quality ----------------------------------------------------------------------------
def _verdicts(checked: DataFrame, key: str, *columns: str) -> DataFrame:
    return checked.select(key, *columns, F.array_join("errors", "; ").alias("errors"))


@job("validate_trips")
def _(spark, sf_dir):
    checked = quality.check_trips(submitted(spark, sf_dir, given.TRIPS_SUBMITTED))
    return _verdicts(checked, "trip_id", "date", "distance_km")


@job("validate_readings")
def _(spark, sf_dir):
    raw = submitted(spark, sf_dir, given.READINGS_SUBMITTED)
    return _verdicts(quality.check_readings(raw, NUMBER_KEY), "record_id", "date_time", "consumption_kwh")


@job("validate_initiatives")
def _(spark, sf_dir):
    checked = quality.check_initiatives(submitted(spark, sf_dir, given.INITIATIVES_SUBMITTED))
    return _verdicts(checked, "initiative_id", "name", "target_reduction_tco2e", "start_date", "end_date")


@job("validate_users")
def _(spark, sf_dir):
    checked = quality.check_users(submitted(spark, sf_dir, given.USERS_SUBMITTED))
    return _verdicts(checked, "user_id", "email", "first_name")


@job("validate_buildings")
def _(spark, sf_dir):
    checked = quality.check_buildings(submitted(spark, sf_dir, given.BUILDINGS_SUBMITTED))
    place = [F.col("location_gps.x").alias("x"), F.col("location_gps.y").alias("y")]
    return _verdicts(checked, "building_id", "name", "sq_footage", *place)


@job("validate_progress")
def _(spark, sf_dir):
    checked = quality.check_progress(submitted(spark, sf_dir, given.PROGRESS_SUBMITTED))
    return _verdicts(checked, "initiative_id", "actual_reduction_tco2e")


# --- constraints ----------------------------------------------------------------------------
query("table_violations")(integrity.table_violations)
query("duplicate_record_ids")(lambda t: integrity.duplicates(t.energy, "record_id"))


@job("orphan_live_readings")
def _(spark, sf_dir):
    return integrity.orphans(live(spark, sf_dir), binding.buildings(spark, sf_dir), "building_id")


@query("energy_with_factor_table")
def _(t):
    rows = [("electricity", Decimal("0.0005")), ("steam", Decimal("0.0002"))]
    factors = t.energy.sparkSession.createDataFrame(rows, "key STRING, factor DECIMAL(6,4)")
    rated = with_energy_co2e(t.energy, factors)
    return rated.groupBy("source").agg(F.sum("co2e_emitted").alias("total_co2e"))


# --- appends --------------------------------------------------------------------------------
def _appended_readings(spark, sf_dir) -> maintain.Change:
    checked = quality.check_readings(submitted(spark, sf_dir, given.READINGS_SUBMITTED), NUMBER_KEY)
    t = ledger(spark, sf_dir)
    return maintain.append_readings(t.energy, t.buildings, quality.accepted(checked), LOADED_AT)


@job("append_readings")
def _(spark, sf_dir):
    return _appended_readings(spark, sf_dir).table


@job("append_readings_refused")
def _(spark, sf_dir):
    return reasons(_appended_readings(spark, sf_dir), "record_id")


def _appended_trips(spark, sf_dir) -> maintain.Change:
    checked = quality.check_trips(submitted(spark, sf_dir, given.TRIPS_SUBMITTED))
    t = ledger(spark, sf_dir)
    return maintain.append_trips(t.trips, t.users, quality.accepted(checked), LOADED_AT)


@job("append_trips")
def _(spark, sf_dir):
    return _appended_trips(spark, sf_dir).table


@job("append_trips_refused")
def _(spark, sf_dir):
    return reasons(_appended_trips(spark, sf_dir), "trip_id")


def _appended_buildings(spark, sf_dir) -> maintain.Change:
    checked = quality.check_buildings(submitted(spark, sf_dir, given.BUILDINGS_SUBMITTED))
    buildings = binding.buildings(spark, sf_dir)
    return maintain.append_unique(buildings, quality.accepted(checked), "building_id", "name", LOADED_AT)


@job("append_buildings_unique")
def _(spark, sf_dir):
    return _appended_buildings(spark, sf_dir).table.select("building_id", "name", "sq_footage", "created_at")


@job("append_buildings_refused")
def _(spark, sf_dir):
    return reasons(_appended_buildings(spark, sf_dir), "building_id")


def _appended_users(spark, sf_dir) -> maintain.Change:
    checked = quality.check_users(submitted(spark, sf_dir, given.USERS_SUBMITTED))
    rows = quality.accepted(checked).withColumn("role", F.lit("user"))
    return maintain.append_unique(binding.users(spark, sf_dir), rows, "user_id", "email", LOADED_AT)


@job("append_users_unique")
def _(spark, sf_dir):
    return _appended_users(spark, sf_dir).table.select("user_id", "email", "role", "first_name", "created_at")


@job("append_users_refused")
def _(spark, sf_dir):
    return reasons(_appended_users(spark, sf_dir), "user_id")


@job("append_initiatives")
def _(spark, sf_dir):
    checked = quality.check_initiatives(submitted(spark, sf_dir, given.INITIATIVES_SUBMITTED))
    t = ledger(spark, sf_dir)
    change = maintain.append_initiatives(t.initiatives, t.users, quality.accepted(checked), LOADED_AT)
    return change.table.drop("description")


# --- updates --------------------------------------------------------------------------------
@job("upsert_readings")
def _(spark, sf_dir):
    updates = submitted(spark, sf_dir, given.READING_UPDATES)
    return maintain.update_readings(live(spark, sf_dir), binding.buildings(spark, sf_dir), updates).table


def _corrected(spark, sf_dir) -> maintain.Change:
    updates = submitted(spark, sf_dir, given.READING_CORRECTIONS)
    return maintain.update_readings(live(spark, sf_dir), binding.buildings(spark, sf_dir), updates)


@job("correct_readings")
def _(spark, sf_dir):
    return _corrected(spark, sf_dir).table


@job("correct_readings_refused")
def _(spark, sf_dir):
    return reasons(_corrected(spark, sf_dir), "record_id")


def _updated_trips(spark, sf_dir) -> maintain.Change:
    return maintain.update_trips(binding.trips(spark, sf_dir), submitted(spark, sf_dir, given.TRIP_UPDATES))


@job("upsert_trips")
def _(spark, sf_dir):
    return _updated_trips(spark, sf_dir).table


@job("upsert_trips_refused")
def _(spark, sf_dir):
    return reasons(_updated_trips(spark, sf_dir), "trip_id")


def _updated_buildings(spark, sf_dir) -> maintain.Change:
    updates = submitted(spark, sf_dir, given.BUILDING_UPDATES)
    updates = updates.withColumn("location_gps", F.lit(None).cast("struct<x:double,y:double>"))
    return maintain.update_buildings(binding.buildings(spark, sf_dir), updates, LOADED_AT)


@job("upsert_buildings")
def _(spark, sf_dir):
    return _updated_buildings(spark, sf_dir).table.drop("location_gps")


@job("upsert_buildings_refused")
def _(spark, sf_dir):
    return reasons(_updated_buildings(spark, sf_dir), "building_id")


@job("upsert_initiatives")
def _(spark, sf_dir):
    updates = submitted(spark, sf_dir, given.INITIATIVE_UPDATES)
    return maintain.update_initiatives(binding.initiatives(spark, sf_dir), updates, LOADED_AT).table


@job("upsert_users")
def _(spark, sf_dir):
    updates = submitted(spark, sf_dir, given.USER_UPDATES)
    return maintain.update_users(binding.users(spark, sf_dir), updates, LOADED_AT).table


@job("patch_initiative_progress")
def _(spark, sf_dir):
    checked = quality.check_progress(submitted(spark, sf_dir, given.PROGRESS_SUBMITTED))
    initiatives = binding.initiatives(spark, sf_dir)
    return maintain.patch_initiative_progress(initiatives, quality.accepted(checked), LOADED_AT).table


# --- deletes --------------------------------------------------------------------------------
def _deleted_trips(spark, sf_dir) -> maintain.Change:
    keys = submitted(spark, sf_dir, given.TRIP_UPDATES)
    return maintain.delete_rows(binding.trips(spark, sf_dir), keys, ["trip_id", "user_id"])


@job("delete_trips")
def _(spark, sf_dir):
    return _deleted_trips(spark, sf_dir).table


@job("delete_trips_refused")
def _(spark, sf_dir):
    return _deleted_trips(spark, sf_dir).refused


@job("delete_readings")
def _(spark, sf_dir):
    keys = submitted(spark, sf_dir, given.READING_UPDATES)
    return maintain.delete_rows(live(spark, sf_dir), keys, ["record_id"]).table


@job("delete_initiatives")
def _(spark, sf_dir):
    initiatives = binding.initiatives(spark, sf_dir)
    cancelled = initiatives.filter(F.col("status") == "cancelled")
    return maintain.delete_rows(initiatives, cancelled, ["initiative_id"]).table


def _guarded(spark, sf_dir) -> maintain.Change:
    t = ledger(spark, sf_dir)
    keys = t.users.select(F.col("user_id").alias("building_id"))
    return maintain.delete_buildings_guarded(t.buildings, t.energy, keys)


@job("delete_buildings_guarded")
def _(spark, sf_dir):
    return _guarded(spark, sf_dir).table.select("building_id", "name")


@job("delete_buildings_guarded_live")
def _(spark, sf_dir):
    t = ledger(spark, sf_dir)
    keys = t.users.select(F.col("user_id").alias("building_id"))
    return maintain.delete_buildings_guarded(t.buildings, live(spark, sf_dir), keys).table.select("building_id", "name")


@job("delete_buildings_refused")
def _(spark, sf_dir):
    return _guarded(spark, sf_dir).refused


@job("delete_cascade_readings")
def _(spark, sf_dir):
    t = ledger(spark, sf_dir)
    dining = t.buildings.filter(F.col("primary_use") == "Dining")
    return maintain.delete_buildings_cascade(t.buildings, t.energy, dining)[1]


def _without_guests(spark, sf_dir):
    t = ledger(spark, sf_dir)
    return maintain.delete_users_cascade(t.users, t.trips, t.initiatives, t.users.filter(F.col("role") == "guest"))


@job("delete_cascade_trips")
def _(spark, sf_dir):
    return _without_guests(spark, sf_dir)[1]


@job("delete_cascade_initiatives")
def _(spark, sf_dir):
    return _without_guests(spark, sf_dir)[2].select("initiative_id", "created_by")


# --- versions -------------------------------------------------------------------------------
def _versioned(spark, sf_dir) -> VersionedFact:
    fact = VersionedFact(spark, f"{_run_folder(spark)}/fact", "energy_consumption")
    fact.create(live(spark, sf_dir))
    return fact


@job("versioned_updates")
def _(spark, sf_dir):
    fact, buildings = _versioned(spark, sf_dir), binding.buildings(spark, sf_dir)
    updates = submitted(spark, sf_dir, given.READING_UPDATES)
    fact.change(updates, ["record_id"], lambda t: maintain.update_readings(t, buildings, updates))
    return fact.read().drop(MONTH_COLUMN)


@job("versioned_deletes")
def _(spark, sf_dir):
    fact, keys = _versioned(spark, sf_dir), submitted(spark, sf_dir, given.READING_UPDATES)
    fact.change(keys, ["record_id"], lambda t: maintain.delete_rows(t, keys, ["record_id"]))
    return fact.read().drop(MONTH_COLUMN)


@job("versioned_appends")
def _(spark, sf_dir):
    """Readings written by month, then new ones beside them."""
    t = ledger(spark, sf_dir)
    fact = VersionedFact(spark, f"{_run_folder(spark)}/fact", "energy_consumption")
    fact.create(t.energy)
    fact.append(_appended_readings(spark, sf_dir).applied)
    return fact.read().drop(MONTH_COLUMN)


# --- nested documents -----------------------------------------------------------------------
@query("reading_documents")
def _(t):
    rows = energy.readings_with_building(t.buildings, t.energy, AS_OF, role="admin")
    nested = documents.reading_documents(rows)
    return nested.select("id", "date_time", "building.name", "building.primary_use", "building.sq_footage")


@query("trip_documents")
def _(t):
    rows = transport.trips_with_user(t.users, t.trips)
    slim = documents.trip_documents(rows).select("id", "mode", F.col("date").cast("string").alias("date"), "user")
    return documents.as_json(slim)


for _name in ("summary", "scopes", "buildings", "monthly_trend", "energy_sources", "transport_modes"):
    query(f"footprint_{_name}")(lambda t, name=_name: overview.carbon_footprint(t, YEAR)[name])


@query("carbon_footprint_document")
def _(t):
    rows = documents.carbon_footprint_document(t, YEAR)
    amount = F.coalesce(*[F.get_json_object("document", f"$.{c}") for c in ("total_co2e_kg", "monthly_co2e")])
    return rows.select("section", "item", amount.cast("double").alias("co2e"))


# --- synthetic data -------------------------------------------------------------------------
query("synth_readings_daily")(lambda t: synth.synth_readings_daily(t.buildings, AS_OF))
query("synth_readings_hourly")(lambda t: synth.synth_readings_hourly(t.buildings, AS_OF))
query("synth_trips")(lambda t: synth.synth_trips(t.users, AS_OF))
query("synth_trips_recent")(lambda t: synth.synth_trips_recent(t.users, AS_OF))
query("sample_trips")(lambda t: synth.sample_rows(t.trips, 0.1, 7, "trip_id"))


# --- streams --------------------------------------------------------------------------------
# The events come in this many files, one a micro-batch; all but the first bring readings of closed windows and known keys.
FILES = 4


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream of several micro-batches, and a folder for the run."""
    folder = _run_folder(spark)
    events = read(spark, sf_dir, "events")
    for k in range(FILES):
        part = events.where(F.pmod("event_id", F.lit(FILES)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = rollups.stream_table(spark, f"{folder}/in", binding.GIVEN["events"], maxFilesPerTrigger="1")
    return stream, folder


def _run_folder(spark: SparkSession) -> str:
    """Below the session's shared folder; a local session without one gets a folder for this run."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{(shared or tempfile.mkdtemp(prefix='checks-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _finished(*stream_queries) -> None:
    for stream_query in stream_queries:
        stream_query.awaitTermination()
        if stream_query.exception() is not None:
            raise stream_query.exception()


def _rolled_up(spark, sf_dir, rollup) -> str:
    stream, folder = _arriving(spark, sf_dir)
    _finished(rollups.start_rollup(live_readings(stream), rollup, folder))
    return folder


@job("stream_daily_rollup")
def _(spark, sf_dir):
    return rollups.windows(spark, _rolled_up(spark, sf_dir, rollups.DAILY), rollups.DAILY)


@job("stream_hourly_trend")
def _(spark, sf_dir):
    folder = _rolled_up(spark, sf_dir, rollups.HOURLY)
    rollups.merge_late(spark, folder, rollups.HOURLY)
    return rollups.windows(spark, folder, rollups.HOURLY)


@job("stream_late_readings")
def _(spark, sf_dir):
    return rollups.late_readings(spark, _rolled_up(spark, sf_dir, rollups.DAILY)).select("record_id", "batch")


def _ingested(spark, sf_dir) -> str:
    stream, folder = _arriving(spark, sf_dir)
    t = ledger(spark, sf_dir)
    _finished(*ingest.start_ingest(stream.selectExpr(*given.READINGS_STREAMED[1]), t.energy, t.buildings, folder, LOADED_AT, NUMBER_KEY))
    return folder


@job("stream_ingest")
def _(spark, sf_dir):
    return spark.read.parquet(str(PurePosixPath(_ingested(spark, sf_dir)) / "readings")).drop("batch")


@job("stream_ingest_refused")
def _(spark, sf_dir):
    return spark.read.parquet(str(PurePosixPath(_ingested(spark, sf_dir)) / "refused")).drop("batch")
