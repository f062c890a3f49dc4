"""Continuous ingest: check, derive, append, and keep what was refused.

Two streaming queries read the submissions.  One takes what needs no memory: rows that break a rule or name an unknown
building are refused, rows without a key get one and are appended.  The other keeps one row of state for each key ever
taken, by a streaming aggregation: when each key came first and last (the micro-batch's own time, which a repeated batch
takes from the log, so that it gives the same output) and its rows.  A key that came first in this batch is new; one that came
in an earlier batch is refused, as is one that the table had from the start.  A primary key has no end of validity, so the
state does not expire: on a cluster keep it in the RocksDB provider (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

import datetime as dt
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderbook.operators.maintain import append_readings
from cinderbook.operators.quality import UUID, check_readings
from cinderbook.streaming.rollups import run

KEY = "record_id"


def start_ingest(
    submissions: DataFrame,
    energy: DataFrame,
    buildings: DataFrame,
    folder: str,
    loaded_at: dt.datetime,
    key_pattern: str = UUID,
    once: bool = True,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Append every micro-batch of submitted readings below `folder`.

    Good rows go to `readings`, the others with their reasons to `refused`, both in one folder per batch of each query, which
    a repeated batch replaces (those of rows without state have negative numbers).  `energy` is the target table.
    """
    root = PurePosixPath(folder)
    checked = check_readings(submissions, key_pattern)
    known = buildings.select(F.col("building_id").alias("_building"), F.lit(True).alias("_known")).distinct()
    judged = checked.join(known, F.col("building_id") == F.col("_building"), "left")
    judged = judged.withColumn("_sound", (F.size("errors") == 0) & F.coalesce("_known", F.lit(False))).drop("_building", "_known")
    if KEY not in judged.columns:
        judged = judged.withColumn(KEY, F.lit(None).cast(energy.schema[KEY].dataType))

    def put(rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(str(root / name / f"batch={number}"))

    def stateless(batch: DataFrame, number: int) -> None:
        new = batch.where(F.col("_sound") & F.col(KEY).isNull()).drop("errors", "_sound")
        change = append_readings(energy, buildings, new, loaded_at, salt=f"batch {number}")
        put(change.applied, "readings", -1 - number)
        reason = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise("unknown building_id")
        broken = batch.where("NOT _sound").select(KEY, reason.alias("reason"))
        put(broken.unionByName(change.refused.select(KEY, "reason")), "refused", -1 - number)

    def stateful(batch: DataFrame, number: int) -> None:
        # The state is updated once: what comes out of it is written first and then read for each use.
        put(batch, "keys", number)
        touched = batch.sparkSession.read.schema(batch.schema).parquet(str(root / "keys" / f"batch={number}"))
        new = touched.where("first = last")
        change = append_readings(energy, buildings, new.select(KEY, "row.*"), loaded_at)
        put(change.applied, "readings", number)
        again = new.where("n > 1").select(KEY, F.lit(f"{KEY} repeated in the batch").alias("reason"))
        late = touched.where("first < last").select(KEY, F.lit(f"{KEY} exists").alias("reason"))
        put(change.refused.select(KEY, "reason").unionByName(again).unionByName(late), "refused", number)

    others = [c for c in judged.columns if c not in (KEY, "errors", "_sound")]
    keyed = judged.where(F.col("_sound") & F.col(KEY).isNotNull()).withColumn("_at", F.current_timestamp())
    state = keyed.groupBy(KEY).agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.max(F.struct(*others)).alias("row"), F.count(F.lit(1)).alias("n")
    )
    return (
        run(state.writeStream.outputMode("update").foreachBatch(stateful), str(root / "keyed"), once),
        run(judged.writeStream.foreachBatch(stateless), str(root / "rest"), once),
    )
