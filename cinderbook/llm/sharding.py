"""Sharding by rendezvous hashing (built-in expressions only).

Every record key scores each shard by a hash of the key and the shard's number; the best weighted score wins. Growing
from n to n + 1 shards leaves all old scores as they are, so a row either stays or moves into the new shard.

Defined results: a null key counts as the empty string; equal keys always share a shard, whatever the text; a null text
has size 1 and checksum 0; an empty table gives an empty result; other columns pass through unchanged, and added columns
overwrite none of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a numbering window should hold on average; the number of windows follows the row count.
WINDOW_ROWS = 20_000


def _score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u uniform in (0, 1): the smallest over all shards wins with a chance in line with its weight."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 15)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 60)
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key. A shard's number is its identity: append new shards at the end."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one per shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = [F.struct(_score(text, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*scored))["shard"]


def with_shards(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """The rows with their shard."""
    return df.withColumn(column, shard_of(df[key], weights))


def with_slots(df: DataFrame, shard: str, order: str, column: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a hash column (lower-case hex).

    Rows are counted per shard and leading hex digits, the counts are summed up over the digits (a small table), and only
    the rows within one such bin are sorted. The number of digits follows the row count, the numbers do not depend on it.
    Ties in the hash are ordered by all other columns, so only rows equal in everything can change places.
    """
    digits, rows = 1, df.count()
    while rows > WINDOW_ROWS * 16**digits:
        digits += 1
    keyed = df.withColumn("__bin", F.substring(df[order], 1, digits))
    bins = keyed.groupBy(shard, "__bin").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col(shard).alias("__shard"),
        F.col("__bin").alias("__at"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"),
    )
    ties = [F.col(c) for c in df.columns if c not in (shard, order)]
    within = Window.partitionBy(shard, "__bin").orderBy(order, *ties)
    joined = keyed.withColumn("__place", F.row_number().over(within)).join(
        bins, (F.col(shard) == F.col("__shard")) & (F.col("__bin") == F.col("__at"))
    )
    return joined.withColumn(column, F.col("__first") + F.col("__place") - 1).select(*df.columns, column)
