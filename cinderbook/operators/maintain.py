"""Batch changes to the tables.

Every job takes a table and a batch of typed rows and returns a `Change` of lazy frames; it never
writes over its input.  Write `change.table` to a new version folder (see `sources.tables`) and
the refused rows next to it.  Batches are reduced to one row per key first, by aggregation, so
that a key repeated through a third of the batch is one row before any join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.functions.factors import with_energy_co2e, with_trip_co2e
from cinderbook.operators import quality
from cinderbook.operators.sizes import broadcast_if_small
from cinderbook.schemas import MONTH_COLUMN


@dataclass
class Change:
    """The new content of the table, the rows inserted, changed or deleted, and those refused."""

    table: DataFrame
    applied: DataFrame
    refused: DataFrame


def latest_per_key(batch: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest `newest` columns, remaining ties by all others."""
    others = [c for c in batch.columns if c not in keys and c not in newest]
    latest = F.max(F.struct(*newest, *others)).alias("_latest")
    return batch.groupBy(*keys).agg(latest).select(*keys, "_latest.*").select(*batch.columns)


def _refuse(rows: DataFrame, reason: str) -> DataFrame:
    return rows.withColumn("reason", F.lit(reason))


def _aligned(rows: DataFrame, table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Give rows the columns of the table: their own, else the default, else NULL."""
    columns = []
    for field in table.schema.fields:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def _without_month(table: DataFrame) -> DataFrame:
    """New and moved rows have no partition month yet; writing the table gives it."""
    return table.drop(MONTH_COLUMN)


def _keyed(batch: DataFrame, table: DataFrame, key: str, loaded_at: dt.datetime, salt: str = "") -> DataFrame:
    """Text keys are generated where missing: from the load time, the row, and its number among equal rows, so that a
    task run again gives the same.  Loads of one time need a salt each."""
    if not isinstance(table.schema[key].dataType, T.StringType):
        return batch
    if key not in batch.columns:
        batch = batch.withColumn(key, F.lit(None).cast("string"))
    equal = batch.filter(F.col(key).isNull()).groupBy(*batch.columns).agg(F.count(F.lit(1)).alias("_n"))
    numbered = equal.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    h = F.md5(F.concat_ws("|", F.lit(loaded_at.isoformat() + salt), F.to_json(F.struct(*batch.columns)), F.col("_i").cast("string")))
    part = lambda start, n: F.substring(h, start, n)
    made = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    return batch.filter(F.col(key).isNotNull()).unionByName(numbered.withColumn(key, made).select(*batch.columns))


def _new_keys(table: DataFrame, rows: DataFrame, key: str, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each key that the table does not have, and what is refused: known keys, and keys given twice.

    Of several rows of a key the largest by its other columns is taken; the refused row beside it is the smallest.
    """
    others = [c for c in rows.columns if c != key]
    packed = F.struct(*others)
    keys = rows.groupBy(key).agg(F.max(packed).alias("_one"), F.min(packed).alias("_other"), F.count(F.lit(1)).alias("_n"))
    one = keys.select(key, "_one.*").select(*rows.columns)
    known = table.select(key).join(broadcast_if_small(one.select(key), batch), key, "left_semi").distinct()
    refused = _refuse(one.join(known, key, "left_semi").select(*rows.columns), f"{key} exists")
    again = keys.filter("_n > 1").select(key, "_other.*").select(*rows.columns)
    return one.join(known, key, "left_anti").select(*rows.columns), refused.unionByName(_refuse(again, f"{key} repeated in the batch"))


def _load_time(loaded_at: dt.datetime) -> Column:
    return F.lit(loaded_at.isoformat(sep=" ")).cast("timestamp_ntz")


# --- append ---------------------------------------------------------------------------------
def append_readings(
    energy: DataFrame, buildings: DataFrame, batch: DataFrame, loaded_at: dt.datetime, salt: str = ""
) -> Change:
    """Add readings of known buildings with their emission."""
    return _append_facts(energy, buildings, batch, "record_id", "building_id", loaded_at, with_energy_co2e, salt)


def append_trips(trips: DataFrame, users: DataFrame, batch: DataFrame, loaded_at: dt.datetime) -> Change:
    """Add trips of known users with their emission."""
    return _append_facts(trips, users, batch, "trip_id", "user_id", loaded_at, with_trip_co2e)


def _append_facts(table, parents, batch, key, parent_key, loaded_at, derive, salt="") -> Change:
    table, batch = _without_month(table), _keyed(batch, table, key, loaded_at, salt)
    known = parents.select(parent_key)
    defaults = {"created_at": _load_time(loaded_at)}
    rows, refused = _new_keys(table, batch.join(known, parent_key, "left_semi").select(*batch.columns), key, batch)
    applied = derive(_aligned(rows, table, defaults)).select(*table.columns)
    unknown = batch.join(known, parent_key, "left_anti").select(*batch.columns)
    refused = _refuse(unknown, f"unknown {parent_key}").unionByName(refused)
    return Change(table.unionByName(applied), applied, refused)


def append_unique(
    table: DataFrame, batch: DataFrame, key: str, unique: str, loaded_at: dt.datetime
) -> Change:
    """Add buildings or users whose key and whose name or address are new.

    Of several rows with the same new value the smallest key is taken.  Batch rows bear a key.
    """
    batch = latest_per_key(batch, [key], [unique])
    taken = batch.join(table.select(key), key, "left_semi").select(*batch.columns)
    batch = batch.join(table.select(key), key, "left_anti").select(*batch.columns)
    first = batch.groupBy(unique).agg(F.min(key).alias(key))
    free = first.join(table.select(unique), unique, "left_anti")
    # The pair (value, key) identifies a batch row: no join on the possibly very common value.
    pair = [unique, key]
    defaults = {"created_at": _load_time(loaded_at), "updated_at": _load_time(loaded_at)}
    applied = _aligned(batch.join(free, pair, "left_semi"), table, defaults)
    others = batch.join(free, pair, "left_anti").join(first.withColumn("_first", F.lit(True)), pair, "left")
    reason = F.when(F.col("_first"), f"{unique} exists").otherwise(f"{unique} repeated in the batch")
    refused = others.withColumn("reason", reason).select(*batch.columns, "reason")
    return Change(table.unionByName(applied), applied, refused.unionByName(_refuse(taken, f"{key} exists")))


def append_initiatives(
    initiatives: DataFrame, users: DataFrame, batch: DataFrame, loaded_at: dt.datetime
) -> Change:
    """Add initiatives.  Only an admin decides the status, suggestions of others are planned.

    `created_by` names the submitter; rows of unknown submitters and known or repeated keys are refused.
    """
    batch = _keyed(batch, initiatives, "initiative_id", loaded_at)
    submitters = users.select(F.col("user_id").alias("created_by"), F.col("role").alias("_role"))
    status = F.when(F.col("_role") == "admin", F.coalesce("status", F.lit("planned"))).otherwise(F.lit("planned"))
    rows = batch.join(submitters, "created_by").withColumn("status", status).select(*batch.columns)
    rows, refused = _new_keys(initiatives, rows, "initiative_id", batch)
    defaults = {
        "created_at": _load_time(loaded_at),
        "updated_at": _load_time(loaded_at),
        "actual_reduction_tco2e": F.lit(0),
    }
    applied = _aligned(rows, initiatives, defaults)
    known = submitters.select("created_by")
    unknown = batch.join(known, "created_by", "left_anti").select(*batch.columns)
    refused = _refuse(unknown, "unknown submitter").unionByName(refused)
    return Change(initiatives.unionByName(applied), applied, refused)


# --- update ---------------------------------------------------------------------------------
def _update(
    table: DataFrame,
    winners: DataFrame,
    batch: DataFrame,
    key: str,
    changes: Callable[[Callable[[str], Column]], dict[str, Column]],
    allowed: Callable[[Callable[[str], Column]], Column] | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    touched_at: dt.datetime | None = None,
    not_allowed: str = "not allowed",
) -> Change:
    """Apply one row per key, reduced from the batch, to the table in a single left join.

    A batch of checked small size is broadcast, so the table is read and written without a
    shuffle; a larger one is joined on the unique key.
    """
    table = _without_month(table)
    fields = [c for c in winners.columns if c != key]
    prefixed = winners.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = table.join(broadcast_if_small(prefixed, batch), key, "left")

    def new(column: str) -> Column:
        return F.col(f"_new_{column}")

    hit = F.coalesce(F.col("_hit"), F.lit(False))
    changed = hit if allowed is None else hit & F.coalesce(allowed(new), F.lit(False))
    values = changes(new)
    if touched_at is not None:
        values["updated_at"] = _load_time(touched_at)
    marked = joined.withColumn("_changed", changed)
    set_columns = {
        name: F.when(F.col("_changed"), value.cast(table.schema[name].dataType)).otherwise(F.col(name))
        for name, value in values.items()
    }
    result = marked.withColumns(set_columns)
    if derive is not None:
        # The derived column follows only where its inputs changed.
        kept = result.withColumn("_kept", F.col("co2e_emitted"))
        result = derive(kept).withColumn(
            "co2e_emitted", F.when(F.col("_changed"), F.col("co2e_emitted")).otherwise(F.col("_kept"))
        )
    refused = _refuse(winners.join(table.select(key), key, "left_anti"), "not found")
    if allowed is not None:
        denied = joined.filter(hit & ~F.coalesce(allowed(new), F.lit(False)))
        denied = denied.select(key, *[new(c).alias(c) for c in fields])
        refused = refused.unionByName(_refuse(denied.select(*winners.columns), not_allowed))
    applied = result.filter(F.col("_changed"))
    return Change(result.select(*table.columns), applied.select(*table.columns), refused)


def _ruled(updates: DataFrame, check: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The updates that keep the rules of new rows, and the others with the rules they break."""
    checked = quality.check_typed(check, updates)
    broken = quality.rejected(checked).withColumn("reason", F.array_join("errors", "; "))
    return quality.accepted(checked).select(*updates.columns), broken.select(*updates.columns, "reason")


def _refusing(change: Change, *refused: DataFrame) -> Change:
    for more in refused:
        change = Change(change.table, change.applied, change.refused.unionByName(more))
    return change


def update_readings(
    energy: DataFrame, buildings: DataFrame, updates: DataFrame, newest: Sequence[str] = ("updated_at",)
) -> Change:
    """Replace building, time, source and amount by key; the emission follows.

    Updates pass the rules of new readings, and their building must exist; of the ones of a key that do, the newest counts.
    """
    columns = ("building_id", "date_time", "source", "consumption_kwh")
    sound, broken = _ruled(updates, lambda df: quality.check_readings(df, key_pattern=""))
    known = buildings.select("building_id")
    unknown = _refuse(sound.join(known, "building_id", "left_anti").select(*updates.columns), "unknown building_id")
    winners = latest_per_key(sound.join(known, "building_id", "left_semi").select(*updates.columns), ["record_id"], newest)
    change = _update(energy, winners, updates, "record_id", lambda new: {c: new(c) for c in columns}, derive=with_energy_co2e)
    return _refusing(change, broken, unknown)


def update_trips(trips: DataFrame, updates: DataFrame, newest: Sequence[str] = ("updated_at",)) -> Change:
    """Replace date, mode and distance by key, only by the trip's own user; the emission follows.

    Updates pass the rules of new trips.
    """
    columns = ("date", "mode", "distance_km")
    sound, broken = _ruled(updates, quality.check_trips)
    winners = latest_per_key(sound, ["trip_id"], newest)
    change = _update(
        trips,
        winners,
        updates,
        "trip_id",
        lambda new: {c: new(c) for c in columns},
        allowed=lambda new: F.col("user_id") == new("user_id"),
        derive=with_trip_co2e,
        not_allowed="not the owner",
    )
    return _refusing(change, broken)


def update_initiatives(
    initiatives: DataFrame,
    updates: DataFrame,
    touched_at: dt.datetime,
    newest: Sequence[str] = ("sent_at",),
) -> Change:
    """Replace all editable columns by key, by the rules of initiatives; a missing actual reduction becomes zero."""
    columns = ("name", "description", "target_reduction_tco2e", "status", "start_date", "end_date")
    sound, broken = _ruled(updates, quality.check_initiative_updates)
    winners = latest_per_key(sound, ["initiative_id"], newest)

    def changes(new):
        actual = F.coalesce(new("actual_reduction_tco2e"), F.lit(0))
        return {c: new(c) for c in columns} | {"actual_reduction_tco2e": actual}

    return _refusing(_update(initiatives, winners, updates, "initiative_id", changes, touched_at=touched_at), broken)


def update_users(
    users: DataFrame, updates: DataFrame, touched_at: dt.datetime, newest: Sequence[str] = ("sent_at",)
) -> Change:
    """Replace names and department by key, by the rules of profiles."""
    columns = ("first_name", "last_name", "department")
    sound, broken = _ruled(updates, quality.check_profiles)
    winners = latest_per_key(sound, ["user_id"], newest)
    change = _update(users, winners, updates, "user_id", lambda new: {c: new(c) for c in columns}, touched_at=touched_at)
    return _refusing(change, broken)


def update_buildings(
    buildings: DataFrame, updates: DataFrame, touched_at: dt.datetime, newest: Sequence[str] = ("sent_at",)
) -> Change:
    """Replace name, area, use and position by key, by the rules of buildings, unless another building has the new name.

    Names are compared with the table before the batch.  Of several buildings asking for one new
    name, the one already bearing it comes first, then the smallest key.
    """
    sound, broken = _ruled(updates, quality.check_buildings)
    winners = latest_per_key(sound, ["building_id"], newest)
    named = buildings.select("building_id", F.col("name").alias("_old"))
    found = winners.join(broadcast_if_small(named), "building_id")
    keeps = F.col("_old") == F.col("name")
    first = found.groupBy("name").agg(F.min(F.struct((~keeps).alias("other"), "building_id")).alias("_first"))
    first = first.select("name", "_first.building_id", F.col("_first.other").alias("_renamed"))
    free = first.filter(~F.col("_renamed")).unionByName(
        first.filter("_renamed").join(buildings.select("name"), "name", "left_anti")
    )
    granted = winners.join(free.select("name", "building_id"), ["name", "building_id"], "left_semi")
    columns = ("name", "sq_footage", "primary_use", "location_gps")
    change = _update(
        buildings,
        granted.select(*winners.columns),
        updates,
        "building_id",
        lambda new: {c: new(c) for c in columns},
        touched_at=touched_at,
    )
    unknown = _refuse(winners.join(buildings.select("building_id"), "building_id", "left_anti"), "not found")
    taken = found.drop("_old").join(free, ["name", "building_id"], "left_anti").select(*winners.columns)
    return Change(change.table, change.applied, unknown.unionByName(_refuse(taken, "name exists")).unionByName(broken))


def patch_initiative_progress(
    initiatives: DataFrame, patches: DataFrame, touched_at: dt.datetime, newest: Sequence[str] = ("sent_at",)
) -> Change:
    """Set actual reduction and status where the patch gives them."""
    winners = latest_per_key(patches, ["initiative_id"], newest)
    columns = ("actual_reduction_tco2e", "status")
    return _update(
        initiatives,
        winners,
        patches,
        "initiative_id",
        lambda new: {c: F.coalesce(new(c), F.col(c)) for c in columns},
        touched_at=touched_at,
    )


# --- delete ---------------------------------------------------------------------------------
def delete_rows(table: DataFrame, keys: DataFrame, by: Sequence[str]) -> Change:
    """Delete rows matching the given key columns (for trips: key and owner)."""
    wanted = keys.select(*by).distinct()
    small = broadcast_if_small(wanted, keys)
    return Change(
        table.join(small, list(by), "left_anti").select(*table.columns),
        table.join(small, list(by), "left_semi").select(*table.columns),
        _refuse(wanted.join(table.select(*by).distinct(), list(by), "left_anti"), "not found"),
    )


def delete_buildings_guarded(buildings: DataFrame, energy: DataFrame, keys: DataFrame) -> Change:
    """Delete buildings that have no readings."""
    wanted = keys.select("building_id").distinct()
    # Only keys asked for are looked up in the readings, each at most once.
    asked = energy.select("building_id").join(broadcast_if_small(wanted, keys), "building_id", "left_semi")
    in_use = asked.distinct()
    change = delete_rows(buildings, wanted.join(in_use, "building_id", "left_anti"), ["building_id"])
    existing = wanted.join(buildings.select("building_id"), "building_id", "left_semi")
    busy = existing.join(in_use, "building_id", "left_semi")
    unknown = wanted.join(buildings.select("building_id"), "building_id", "left_anti")
    refused = _refuse(busy, "has readings").unionByName(_refuse(unknown, "not found"))
    return Change(change.table, change.applied, refused)


def delete_buildings_cascade(buildings: DataFrame, energy: DataFrame, keys: DataFrame) -> tuple[Change, DataFrame]:
    """Delete buildings and, with them, their readings; returns also the remaining readings."""
    change = delete_rows(buildings, keys, ["building_id"])
    gone = broadcast_if_small(change.applied.select("building_id"), keys)
    return change, energy.join(gone, "building_id", "left_anti").select(*energy.columns)


def delete_users_cascade(
    users: DataFrame, trips: DataFrame, initiatives: DataFrame, keys: DataFrame
) -> tuple[Change, DataFrame, DataFrame]:
    """Delete users with their trips; their initiatives stay without a creator."""
    change = delete_rows(users, keys, ["user_id"])
    deleted = change.applied.select("user_id")
    gone = broadcast_if_small(deleted, keys)
    left = trips.join(gone, "user_id", "left_anti").select(*trips.columns)
    marks = deleted.select(F.col("user_id").alias("created_by"), F.lit(True).alias("_gone"))
    marked = initiatives.join(broadcast_if_small(marks, keys), "created_by", "left")
    creator = F.when(F.col("_gone").isNull(), F.col("created_by"))
    return change, left, marked.withColumn("created_by", creator).select(*initiatives.columns)
