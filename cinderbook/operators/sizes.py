"""Broadcasting behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A batch up to this many rows and bytes is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(
    df: DataFrame, source: DataFrame | None = None, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark the frame for broadcast when it is proven to have at most `rows` rows of `most` bytes in all.

    Meant for the narrow side (keys or a change batch) of a join with a large table, which then
    is neither shuffled nor sorted.  `source` is a frame with at least as many rows, and at least as
    wide, that is cheaper to measure.  Rows are counted first, up to the bound; only a frame within it
    has its bytes added up, the lengths of texts beside the fixed widths of the other types.  A frame
    not marked is joined by shuffle, where adaptive execution splits hot keys.
    """
    measured = df if source is None else source
    count = measured.limit(rows + 1).count()
    return F.broadcast(df) if count <= rows and _bytes(measured, count) <= most else df


def _bytes(df: DataFrame, count: int) -> int:
    fixed, widths = 0, []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.octet_length(field.name))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(F.length(F.to_json(F.struct(field.name))))
        fixed += 16
    if not widths:
        return count * fixed
    return count * fixed + (df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in widths), F.lit(0)))).first()[0] or 0)
