"""Helpers the text operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="llm-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and go on from there: the lineage ends at files any executor can read.

    Each call takes a new folder, which is the caller's to clear with the rest of spark.checkpoint.dir.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _shipped(application: str) -> None:
    """Send this package's modules to the executors, once per application; there they may not be installed."""
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(str(archive))


def shipped(spark: SparkSession) -> None:
    """Needed before functions of this package run in Python workers."""
    _shipped(spark.sparkContext.applicationId)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow for functions of this package."""
    shipped(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_of(df: DataFrame, text: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text], F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, near the given ones (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces_of(text: Column) -> Column:
    """A text cut at every single blank, empty pieces included. Only spaces are left to split at, which takes no pattern."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " ")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(pieces_of(text), "")


def beside(df: DataFrame, added: list[str], build) -> DataFrame:
    """build(df) with its columns `added`, where the frame may have columns of these names itself: they stay, and the added
    ones get a name of their own near it."""
    names = {a.lower() for a in added}
    hidden = {c: f"__own_{c}" for c in df.columns if c.lower() in names}
    out = build(df.withColumnsRenamed(hidden))
    own = [F.col(hidden.get(c, c)).alias(c) for c in df.columns]
    return out.select(*own, *[F.col(a).alias(n) for a, n in zip(added, fresh(df, *added), strict=True)])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about `most` bytes of text (one row at least), so that a task's memory has a bound."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
