"""Run registered queries and their SQL side by side: `python -m checks.compare [sf_dir] [name ...]`."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

import checks.jobs  # noqa: F401  (registers)
import checks.oracle_jobs  # noqa: F401  (registers)
from checks.oracle import SQL
from checks.queries import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinderbook")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(flat, key=repr)


def difference(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when Spark and SQL agree on columns, rows and values, else what differs."""
    df = REGISTRY[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows"
    unlike = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unlike:
        return f"{len(unlike)} of {len(ours)} rows differ, first {unlike[0][0]} / {unlike[0][1]}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in args or sorted(REGISTRY):
        started = time.time()
        try:
            if name in SQL:
                problem = difference(spark, con, name, sf_dir)
            else:
                problem = f"rows only: {REGISTRY[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{time.time() - started:6.2f}s {name}: {problem or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
