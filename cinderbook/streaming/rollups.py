"""Windowed rollups of live readings that lose none of them.

Every micro-batch adds up its own readings by window, on the map side, and writes these partial totals to a folder named by
its number, so that a batch repeated after a failure replaces its own output.  Windows are sums of partial totals; no state
is held in memory, however many windows are open.

The watermark of a batch is the latest event time of the batches before it, less a delay.  A window whose end it has passed
is closed.  Readings for closed windows are late: they go to a side folder as they are, and `merge_late` puts them, with all
partial totals so far, into a new version of the windows.  `windows` is the newest version and what came after it.

Folders below the one given: `windows/batch=N`, `late/batch=N`, `progress/batch=N` (latest event time so far) and
`versions/upto=N` (totals of all batches up to N, late readings included).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cinderbook.functions.factors import with_energy_co2e

DELAY = "1 day"


@dataclass(frozen=True)
class Rollup:
    """Totals per window of a length, and per value of the keys."""

    length: str
    keys: tuple[str, ...] = ()

    @property
    def by(self) -> tuple[str, ...]:
        return ("period", *self.keys)


DAILY = Rollup("1 day")
HOURLY = Rollup("1 hour", ("building_id",))


def stream_table(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    """Files arriving in a folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def event_time(column: str) -> Column:
    """A zoneless time read as UTC: windows need an instant, whatever the session time zone.

    Goes through microseconds, because arithmetic on instants follows the session's clock changes.
    """
    seconds = f"CAST(CAST({column} - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20,6))"
    return F.expr(f"timestamp_micros(CAST({seconds} * 1000000 AS BIGINT))")


def _zoneless(instant: Column) -> Column:
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + since


def _timed(readings: DataFrame, rollup: Rollup) -> DataFrame:
    if "co2e_emitted" not in readings.columns:
        readings = with_energy_co2e(readings)
    return readings.withColumn("_time", event_time("date_time")).withColumn("_window", F.window("_time", rollup.length))


TOTALS = {"record_count": "bigint", "total_consumption_kwh": "decimal(38,2)", "total_co2e_emitted": "decimal(38,4)"}


def totals(readings: DataFrame, rollup: Rollup) -> DataFrame:
    """Readings, consumption and emissions per window; readings without a time are in none."""
    timed = _timed(readings, rollup).where("_time IS NOT NULL")
    values = (F.count(F.lit(1)), F.sum("consumption_kwh"), F.sum("co2e_emitted"))
    summed = timed.groupBy("_window", *rollup.keys).agg(*[v.cast(t).alias(n) for v, (n, t) in zip(values, TOTALS.items(), strict=True)])
    return summed.select(_zoneless(F.col("_window.start")).alias("period"), *rollup.keys, *TOTALS)


def _added(parts: DataFrame, rollup: Rollup) -> DataFrame:
    return parts.groupBy(*rollup.by).agg(*[F.sum(n).cast(t).alias(n) for n, t in TOTALS.items()])


def start_rollup(readings: DataFrame, rollup: Rollup, folder: str, delay: str = DELAY, once: bool = True) -> StreamingQuery:
    """Keep the windows of a stream of readings up to date below `folder`."""
    root = PurePosixPath(folder)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        timed = _timed(batch, rollup).persist()
        try:
            newest = F.lit(None).cast("timestamp")
            if number > 0:
                newest = F.lit(spark.read.parquet(str(root / "progress" / f"batch={number - 1}")).first()["newest"])
            is_late = F.coalesce(F.col("_window.end") <= newest - F.expr(f"INTERVAL {delay}"), F.lit(False))
            own = [c for c in timed.columns if c not in ("_time", "_window")]
            put = lambda df, name: df.write.mode("overwrite").parquet(str(root / name / f"batch={number}"))
            put(totals(timed.where(~is_late).select(*own), rollup), "windows")
            put(timed.where(is_late).select(*own), "late")
            put(timed.agg(F.greatest(F.max("_time"), newest).alias("newest")), "progress")
        finally:
            timed.unpersist()

    return run(readings.writeStream.foreachBatch(write), folder, once)


def run(writer, folder: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", str(PurePosixPath(folder) / "checkpoint"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def _folders(spark: SparkSession, path: PurePosixPath) -> list[int]:
    """Numbers N of the folders name=N below a path that are written whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(str(path))
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath() for s in fs.listStatus(where) if s.isDirectory() and "=" in s.getPath().getName()]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _since(spark: SparkSession, folder: str, rollup: Rollup, late: bool) -> tuple[DataFrame | None, int]:
    """Partial totals of the newest version and of the batches after it, and the last batch."""
    root = PurePosixPath(folder)
    versions, batches = _folders(spark, root / "versions"), _folders(spark, root / "windows")
    upto = versions[-1] if versions else -1
    parts = [spark.read.parquet(str(root / "versions" / f"upto={upto}"))] if versions else []
    read = lambda name: spark.read.parquet(*[str(root / name / f"batch={n}") for n in batches if n > upto])
    if any(n > upto for n in batches):
        parts.append(read("windows"))
        if late:
            parts.append(totals(read("late"), rollup))
    columns = [*rollup.by, *TOTALS]
    out = None
    for part in parts:
        out = part.select(*columns) if out is None else out.unionByName(part.select(*columns))
    return out, batches[-1] if batches else -1


def windows(spark: SparkSession, folder: str, rollup: Rollup, late: bool = True) -> DataFrame:
    """All windows; without `late`, as they stand before the late readings that no merge has put in yet."""
    parts, _ = _since(spark, folder, rollup, late)
    if parts is None:
        raise ValueError(f"no batch was written below {folder}")
    return _added(parts, rollup)


def closed_windows(spark: SparkSession, folder: str, rollup: Rollup, delay: str = DELAY) -> DataFrame:
    """Windows that the watermark of the next batch has passed: only late readings can change them."""
    last = _folders(spark, PurePosixPath(folder) / "progress")[-1]
    newest = spark.read.parquet(str(PurePosixPath(folder) / "progress" / f"batch={last}"))
    bound = newest.select((_zoneless(F.col("newest")) - F.expr(f"INTERVAL {delay}") - F.expr(f"INTERVAL {rollup.length}")).alias("bound"))
    return windows(spark, folder, rollup).where(F.col("period") <= F.lit(bound.first()["bound"]))


def late_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading that came after its window had closed, with the number of its batch."""
    return spark.read.parquet(str(PurePosixPath(folder) / "late"))


def merge_late(spark: SparkSession, folder: str, rollup: Rollup) -> int:
    """Write a new version of all windows, late readings put in; returns the last batch in it.

    Nothing is written twice or over: a version that is there already stays, one left half written by a failed run is replaced.
    """
    parts, upto = _since(spark, folder, rollup, late=True)
    root = PurePosixPath(folder) / "versions"
    if parts is not None and upto not in _folders(spark, root):
        _added(parts, rollup).write.mode("overwrite").parquet(str(root / f"upto={upto}"))
    return upto
