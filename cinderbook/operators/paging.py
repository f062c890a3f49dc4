"""Top-k, pages and page metadata."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.params import Page, check_positive


def top(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """First rows in the given order: every task keeps `limit` rows, one task merges them."""
    return df.orderBy(*order).limit(check_positive(limit, "limit"))


def page_of(df: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """One page by offset.  The order must end in unique columns, or pages overlap.

    Every task keeps offset + size rows, which is fine for the first pages; deep in a large table
    use `page_at` or `page_after`.
    """
    return df.orderBy(*order).offset(page.offset).limit(page.size)


# Up to this offset the tasks' first rows are merged; beyond it the page is located first.
SHALLOW = 10_000
# Rows of a bucket that are sorted as they are; a day with more is counted by the second.
BUCKET_ROWS = 1_000_000


def page_at(
    df: DataFrame, time: str, order: Sequence[Column], page: Page, keys: DataFrame | None = None, key: str | None = None,
    shallow: int = SHALLOW, most: int = BUCKET_ROWS,
) -> DataFrame:
    """A page at any depth of rows ordered by `time`, newest first and missing times before all, then by `order`.

    Rows are counted by day, and the days' running sums tell which ones the page lies in; a day of more than `most` rows is
    counted again by the second.  Only that stretch of time is read and sorted, so no task holds more than it, at any depth.
    With `keys`, only rows whose `key` stands there count; they are counted by day and key before they meet the keys.
    """
    known = (lambda rows: rows) if keys is None else (lambda rows: rows.join(keys.select(key).distinct(), key, "left_semi"))
    newest = [F.col(time).desc_nulls_first(), *order]
    if page.offset <= shallow:
        return known(df).orderBy(*newest).offset(page.offset).limit(page.size)
    kind = df.schema[time].dataType
    by = [] if keys is None else [key]

    def buckets(rows: DataFrame, bucket: Column) -> list[tuple]:
        counts = known(rows.groupBy(bucket.alias("bucket"), *by).agg(F.count(F.lit(1)).alias("n")))
        found = [(r["bucket"], r["n"]) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
        return sorted((f for f in found if f[0] is None), key=lambda f: 0) + sorted((f for f in found if f[0] is not None), reverse=True)

    def spanned(found: list[tuple], offset: int) -> tuple[list, int, int]:
        """Buckets the page lies in, rows before the first of them, and rows in them."""
        chosen, before, inside, passed = [], 0, 0, 0
        for bucket, n in found:
            if passed + n > offset and passed < offset + page.size:
                before = passed if not chosen else before
                chosen.append(bucket)
                inside += n
            passed += n
        return chosen, before, inside

    days, before, inside = spanned(buckets(df, F.col(time).cast("date")), page.offset)
    if not days:
        return known(df).limit(0)
    dated = [d for d in days if d is not None]
    stretch = F.lit(False)
    if dated:
        first, last = F.lit(dated[-1]).cast(kind), F.lit(dated[0] + dt.timedelta(days=1)).cast(kind)
        stretch = (F.col(time) >= first) & (F.col(time) < last)
    if None in days:
        stretch = stretch | F.col(time).isNull()
    rows = df.where(stretch)
    if inside > most and days == dated and len(days) == 1 and not isinstance(kind, T.DateType):
        second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time).cast("int")
        seconds, more, _ = spanned(buckets(rows, second), page.offset - before)
        start = dt.datetime.combine(days[0], dt.time())
        low, high = (F.lit((start + dt.timedelta(seconds=s)).isoformat(sep=" ")).cast(kind) for s in (seconds[-1], seconds[0] + 1))
        rows, before = rows.where((F.col(time) >= low) & (F.col(time) < high)), before + more
    return known(rows).orderBy(*newest).offset(page.offset - before).limit(page.size)


def page_after(df: DataFrame, newest_first: Sequence[str], last_seen: Sequence, size: int) -> DataFrame:
    """The page following the row with the given key values (keyset paging), all keys descending.

    The cost does not grow with the depth, and the bound on the leading key reaches the scan.
    """
    if len(newest_first) != len(last_seen):
        raise ValueError("one value per ordering column is needed")
    keys = [F.col(c) for c in newest_first]
    values = [F.lit(v) for v in last_seen]
    branches = []
    for i in range(len(keys)):
        same = [keys[j] == values[j] for j in range(i)]
        branches.append(reduce(lambda a, b: a & b, [*same, keys[i] < values[i]]))
    following = (keys[0] <= values[0]) & reduce(lambda a, b: a | b, branches)
    return top(df.filter(following), [k.desc_nulls_last() for k in keys], size)


def page_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], page: Page) -> DataFrame:
    """The same page for every key at once.

    The row-number filter is applied before the shuffle too (each task keeps offset + size rows
    per key), so a key holding most of the table does not end up in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") <= page.offset + page.size)
        .filter(F.col("_place") > page.offset)
        .drop("_place")
    )


def page_info(df: DataFrame, page: Page, rows: str | None = None) -> DataFrame:
    """One row: position of the page among all pages of the frame, each row counting as many as its column `rows` says."""
    counted = F.count(F.lit(1)) if rows is None else F.coalesce(F.sum(rows), F.lit(0).cast("bigint"))
    pages = F.ceil(F.col("total_records").cast("double") / F.lit(page.size)).cast("bigint")
    return df.agg(counted.alias("total_records")).select(
        F.lit(page.number).cast("bigint").alias("current_page"),
        pages.alias("total_pages"),
        F.col("total_records"),
        (F.lit(page.number) < pages).alias("has_next"),
        F.lit(page.number > 1).alias("has_prev"),
    )


def numbered(df: DataFrame, order: Sequence[Column], into: str = "rank") -> DataFrame:
    """Position in the report.  Only for frames already limited to a few rows."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy().orderBy(*order)).cast("bigint"))
