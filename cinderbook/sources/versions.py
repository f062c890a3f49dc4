"""Facts kept in versions, of which a change writes only the months that it touches.

Below a root there are data folders, `data/v=N/<month>=...`, and one small manifest a version, `manifests/version=N`: the
pairs (v, month) that the version is made of.  A change finds the months that its keys lie in, reads and rewrites these, and
refers to the folders of the others; an append adds folders and rewrites none.  A version is there once its manifest is
complete, so a failed run leaves the newest version as it was and its folder is written again.  One writer at a time.

Old versions stay readable.  Pruning by date works as in a table written in one go.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.functions.exprs import month_of
from cinderbook.operators.maintain import Change
from cinderbook.operators.sizes import broadcast_if_small
from cinderbook.schemas import FACT_TIME, MONTH_COLUMN

NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path of any file system Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def complete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class VersionedFact:
    """One fact table (`table` is its name in the model) below `root`."""

    def __init__(self, spark: SparkSession, root: str, table: str):
        self.spark, self.root, self.time = spark, PurePosixPath(root), FACT_TIME[table]

    def versions(self) -> list[int]:
        path = str(self.root / "manifests")
        found = [n for n in subfolders(self.spark, path) if n.startswith("version=")]
        return sorted(int(n.split("=")[1]) for n in found if complete(self.spark, f"{path}/{n}"))

    def folders(self, version: int | None = None) -> list[tuple[int, str]]:
        """(v, month) of a version, the newest by default: a row a month and change, however many readings there are."""
        number = self.versions()[-1] if version is None else version
        rows = self.spark.read.parquet(str(self.root / "manifests" / f"version={number}")).collect()
        return sorted((r["v"], r["month"]) for r in rows)

    def read(self, version: int | None = None, months: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, of all months or the given ones, with their month."""
        number = self.versions()[-1] if version is None else version
        chosen = [(v, m) for v, m in self.folders(number) if months is None or m in months]
        schema = self.spark.read.parquet(str(self.root / "schema")).schema
        if not chosen:
            return self.spark.createDataFrame([], schema.add(MONTH_COLUMN, T.DateType()))
        paths = [str(self.root / "data" / f"v={v}" / f"{MONTH_COLUMN}={m}") for v, m in chosen]
        typed = T.StructType([*schema.fields, T.StructField("v", T.IntegerType()), T.StructField(MONTH_COLUMN, T.DateType())])
        return self.spark.read.schema(typed).option("basePath", str(self.root / "data")).parquet(*paths).drop("v")

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        if self.versions():
            raise ValueError(f"{self.root} has versions already")
        rows = rows.drop(MONTH_COLUMN)
        rows.limit(0).write.mode("overwrite").parquet(str(self.root / "schema"))
        return self._write(rows, [])

    def append(self, rows: DataFrame) -> int:
        """A version with more rows: nothing is rewritten."""
        return self._write(rows, self.folders())

    def change(self, keys: DataFrame, by: Sequence[str], job: Callable[[DataFrame], Change]) -> Change:
        """A version in which `job` has changed the months that hold the keys.

        job gets the rows of those months only, and looks for no others; rows that it moves to another month are added there.
        The change returned has the rows of the touched months as its table.
        """
        asked = broadcast_if_small(keys.select(*by).distinct(), keys.select(*by))
        hit = self.read().join(asked, list(by), "left_semi").select(MONTH_COLUMN).distinct().collect()
        touched = {_name(r[0]) for r in hit}
        change = job(self.read(months=touched))
        if touched:
            self._write(change.table, [(v, m) for v, m in self.folders() if m not in touched])
        return change

    def _write(self, rows: DataFrame, kept: list[tuple[int, str]]) -> int:
        number = (self.versions() or [-1])[-1] + 1
        data = str(self.root / "data" / f"v={number}")
        by_month = rows.drop(MONTH_COLUMN).withColumn(MONTH_COLUMN, month_of(F.col(self.time)))
        by_month.hint("rebalance", F.col(MONTH_COLUMN)).write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(data)
        own = [(number, n.split("=", 1)[1]) for n in subfolders(self.spark, data) if n.startswith(f"{MONTH_COLUMN}=")]
        manifest = self.spark.createDataFrame([*kept, *own], "v INT, month STRING")
        manifest.coalesce(1).write.mode("overwrite").parquet(str(self.root / "manifests" / f"version={number}"))
        return number


def _name(month: dt.date | None) -> str:
    return NO_MONTH if month is None else month.isoformat()
