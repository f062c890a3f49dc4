"""What the operators on vectors share: which rows count, whole numbers from entries, and packed blocks of them.

A row counts if its vector is not null, holds no null and no non-finite entry, and is as long as most of the others (of two
lengths equally frequent the larger).  Empty vectors never count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbook.llm.common import mapped

ROWS = 8192  # vectors of a block
KINDS = tuple(np.dtype(k) for k in ("<i1", "<i2", "<i4", "<i8"))


def sound(vector: Column) -> Column:
    """No null, no NaN, no infinity."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def rows_of(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that count, their vectors as doubles, and the length of the vectors (0: no row)."""
    rows = df.withColumn(vector, F.col(vector).cast("array<double>")).where(sound(F.col(vector)) & (F.size(vector) > 0))
    found = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = found["size"] if found else 0
    return rows.where(F.size(vector) == dims), dims


def whole(batch: pa.RecordBatch, place: int, dims: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * entry) of a batch's vectors, a row each; what lies beyond `most` either way counts as `most`."""
    entries = batch.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * scale), -float(most), float(most)).astype(np.int64)


def narrow(x: np.ndarray) -> int:
    """Number in KINDS of the smallest type that holds all of x."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(k for k, kind in enumerate(KINDS) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)


def totals(blocks: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray | float]], kind: str) -> dict:
    """Sums over all tasks of what `function` makes of a task's blocks: numbers by index.

    Every task sends a row an index, which are added up by index in Spark; the driver gets one row an index, however many
    tasks there are.  function returns (indexes, values), both arrays.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = function(batches)
        if len(at):
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(values)], ["at", "value"])

    found = mapped(blocks, rows, f"at long, value {kind}")
    summed = F.sum("value") if kind == "double" else F.sum(F.col("value").cast("decimal(38,0)"))
    return {r["at"]: r["value"] for r in found.groupBy("at").agg(summed.alias("value")).collect()}
