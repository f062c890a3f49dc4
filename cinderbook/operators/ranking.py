"""Ranks, percent ranks and percentiles over a whole table.

`rank() OVER (ORDER BY x)` has no partition key: Spark moves every row into one task.  That is
right for a frame of small size (one row per building of a campus) and hopeless for one row per
user of a large organisation.  So every function here takes `partitioned`: False plans the plain
window, True the range-partitioned method.  Nothing is counted to choose; the results are equal.

The range-partitioned method cuts the value axis at approximate quantiles.  Each cut value is a
bucket of its own, the open intervals between cuts are the others:

* rows equal to a cut are all tied, so they need no ordering however many there are -- a value
  held by a third of all rows is necessarily a cut;
* an open interval holds about 1/n of the rows, and is ordered by an ordinary window;
* the rows below a bucket come from one count per bucket, at most twice the number of cuts.

The result is exact; only the evenness of the buckets is approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of an interval between two cuts, about.
INTERVAL_ROWS = 200_000

_BELOW, _TIES, _TOTAL = "_rows_below", "_rows_tied", "_rows_total"


def with_global_rank(
    df: DataFrame,
    measure: str,
    *,
    rank: str | None = None,
    descending: bool = True,
    percent_rank: str | None = None,
    total: str | None = None,
    partitioned: bool = False,
) -> DataFrame:
    """Add columns computed over the whole frame.

    `rank` orders by the measure in the given direction, `percent_rank` always ascending, and
    `total` is the number of rows.  NULLs are the largest value: first when descending, last
    when ascending.
    """
    if not partitioned:
        return _ranked_in_one_task(df, measure, rank, descending, percent_rank, total)
    placed = place_rows(df, measure)
    below, ties, rows = F.col(_BELOW), F.col(_TIES), F.col(_TOTAL)
    added = {}
    if rank:
        added[rank] = 1 + (rows - below - ties if descending else below)
    if percent_rank:
        added[percent_rank] = F.when(rows > 1, below.cast("double") / (rows - 1)).otherwise(F.lit(0.0))
    if total:
        added[total] = rows
    return placed.withColumns(added).drop(_BELOW, _TIES, _TOTAL)


def _ranked_in_one_task(df, measure, rank, descending, percent_rank, total) -> DataFrame:
    value = F.col(measure)
    everything = Window.partitionBy()
    upwards = everything.orderBy(value.asc_nulls_last())
    downwards = everything.orderBy(value.desc_nulls_first())
    added = {}
    if rank:
        added[rank] = F.rank().over(downwards if descending else upwards).cast("bigint")
    if percent_rank:
        added[percent_rank] = F.percent_rank().over(upwards)
    if total:
        added[total] = F.count(F.lit(1)).over(everything)
    return df.withColumns(added)


def place_rows(df: DataFrame, measure: str, cuts: int | None = None) -> DataFrame:
    """Add, per row: how many rows are below it, how many share its value, how many there are.

    The frame is read for the cuts, for the counts and for the result, so it should be a small
    aggregation with exact sums: computed again, it gives the same rows.  It is kept while the
    session runs; a lost part is computed again.  The number of cuts follows the row count.
    """
    df = df.persist()
    kind = df.schema[measure].dataType
    if cuts is None:
        cuts = max(4, -(-df.count() // INTERVAL_ROWS))
    steps = [F.lit(i / cuts) for i in range(1, cuts)]
    found = df.agg(F.percentile_approx(measure, F.array(*steps), F.lit(10_000))).first()[0] or []
    bounds = sorted(set(found))
    value = F.col(measure)

    if bounds:
        axis = F.array(*[F.lit(b).cast(kind) for b in bounds])
        passed = F.size(F.filter(axis, lambda bound: bound < value))
        on_cut = F.get(axis, passed) == value
        bucket = passed * 2 + F.when(on_cut, 1).otherwise(0)
        # NULLs are tied with each other and come after every value.
        bucket = F.when(value.isNull(), F.lit(2 * len(bounds) + 1)).otherwise(bucket)
    else:
        bucket = F.lit(1)
    bucketed = df.withColumn("_bucket", bucket)

    # Two rows a cut: one for each 100,000 rows of the frame.
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    in_order = Window.partitionBy().orderBy("_bucket")
    offsets = sizes.select(
        F.col("_bucket"),
        F.col("_size"),
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(Window.partitionBy()).alias(_TOTAL),
    )

    tied = bucketed.filter(F.col("_bucket") % 2 == 1).withColumns(
        {"_inside": F.lit(0).cast("bigint"), _TIES: F.lit(None).cast("bigint")}
    )
    spread = bucketed.filter(F.col("_bucket") % 2 == 0).withColumns(
        {
            "_inside": (F.rank().over(Window.partitionBy("_bucket").orderBy(value)) - 1).cast("bigint"),
            _TIES: F.count(F.lit(1)).over(Window.partitionBy("_bucket", measure)),
        }
    )
    return (
        tied.unionByName(spread)
        .join(offsets, "_bucket")
        .withColumns(
            {
                _BELOW: F.col("_offset") + F.col("_inside"),
                _TIES: F.coalesce(F.col(_TIES), F.col("_size")),
            }
        )
        .drop("_bucket", "_offset", "_size", "_inside")
    )


def with_percentiles(
    df: DataFrame,
    measure: str,
    fractions: Sequence[float],
    into: str,
    *,
    partitioned: bool = False,
) -> DataFrame:
    """Add the exact interpolated percentiles of the measure as an array column."""
    if not partitioned:
        points = F.array(*[F.lit(float(f)) for f in fractions])
        cut_points = F.percentile(measure, points).over(Window.partitionBy())
        return df.withColumn(into, cut_points)
    values = distributed_percentiles(df, measure, fractions)
    return df.withColumn(into, F.array(*[F.lit(v).cast("double") for v in values]))


def distributed_percentiles(df: DataFrame, measure: str, fractions: Sequence[float]) -> list[float | None]:
    """Exact interpolated percentiles through row positions, NULLs left out.

    Returns one number per fraction; the driver sees at most two values for each.
    """
    placed = place_rows(df.select(measure).filter(F.col(measure).isNotNull()), measure)
    first = placed.select(_TOTAL).first()
    if first is None:
        return [None] * len(fractions)
    positions = [f * (first[0] - 1) for f in fractions]
    wanted = sorted({int(p) for p in positions} | {min(int(p) + 1, first[0] - 1) for p in positions})
    covers = F.lit(False)
    for index in wanted:
        covers = covers | ((F.col(_BELOW) <= index) & (F.col(_BELOW) + F.col(_TIES) > index))
    held = [
        (row[_BELOW], row[_TIES], float(row[measure]))
        for row in placed.filter(covers).select(measure, _BELOW, _TIES).distinct().collect()
    ]

    def value_at(index: int) -> float:
        return next(v for below, ties, v in held if below <= index < below + ties)

    result = []
    for position in positions:
        lower = int(position)
        share = position - lower
        low = value_at(lower)
        high = value_at(lower + 1) if share > 0 else low
        result.append(low + (high - low) * share)
    return result


def share_of_total(part: Column) -> Column:
    """Percent of the column total.  Only for frames with a fixed handful of rows (the scopes)."""
    whole = F.sum(part).over(Window.partitionBy())
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
