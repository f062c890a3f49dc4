"""Vector codes: each vector is cut into PARTS parts, each replaced by the number of its nearest codebook entry.

Components become whole numbers, floor(SCALE * x), and everything after that is exact.  Vectors are kept in blocks.  A block
has a dictionary for each dimension, the distinct integers that stand there, and a matrix of dictionary codes.  For a codebook
the squared difference of every distinct integer to every entry is tabulated once a block; the distance of a part to all
entries is then a sum of gathered table rows, and no component is multiplied again.  A dictionary is never longer than its
block, so tables are bounded for any data.

Codebooks start as the parts of the ENTRIES first vectors by id.  A round assigns every part to its nearest entry (the first
of equally near ones) and moves each entry to the floor of the mean of its parts; sums are added up in Spark by entry and
dimension, and only the codebooks come to the driver.

Defined results: rows that do not count (see `vectors`) are left out; components beyond 2^40 / SCALE count as that; with
fewer rows than ENTRIES there are as many entries as rows; of equal ids the smaller vector comes first, null ids come last;
where the parts cannot be equal the first ones are one longer; an error that needs more than a long is null; an empty table
gives an empty result; other columns pass through, added ones get a name of their own where the table has it already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.llm.common import fresh, mapped, saved
from cinderbook.llm.vectors import ROWS, rows_of, totals, whole
from cinderbook.operators.sizes import broadcast_if_small

SCALE = 1024
MOST = 1 << 40
PARTS, ENTRIES, ROUNDS = 4, 256, 4
STEP = 1024  # vectors whose distances are held at a time


def _cuts(dims: int) -> list[int]:
    sizes = [len(p) for p in np.array_split(np.arange(dims), PARTS)]
    return np.cumsum([0, *sizes]).tolist()


class Block:
    """Dictionaries and dictionary codes of some vectors."""

    def __init__(self, dictionaries: list[np.ndarray], codes: np.ndarray):
        self.dictionaries, self.codes = dictionaries, codes

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in x.T]
        return cls([v for v, _ in found], np.stack([c for _, c in found], axis=1).astype(np.uint16))

    def whole(self, first: int, last: int) -> np.ndarray:
        """The integers themselves in dimensions first to last."""
        return np.stack([self.dictionaries[j][self.codes[:, j]] for j in range(first, last)], axis=1)

    def nearest(self, book: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry for the part that begins at dimension `first`, and its squared distance."""
        dims = range(first, first + book.shape[1])
        reach = max([1, *(int(max(abs(d[0]), abs(d[-1]))) for d in (self.dictionaries[j] for j in dims)), int(np.abs(book).max(initial=0))])
        most = 4 * reach * reach * max(1, len(dims))
        kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
        tables = [np.square(self.dictionaries[j].astype(kind)[:, None] - book[:, i].astype(kind)[None, :]) for i, j in enumerate(dims)]
        chosen, error = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes), object if kind is object else np.int64)
        for at in range(0, len(self.codes), STEP):
            codes = self.codes[at : at + STEP]
            distance = np.zeros((len(codes), len(book)), kind)
            for i, j in enumerate(dims):
                distance += tables[i][codes[:, j]]
            best = distance.argmin(axis=1)
            chosen[at : at + STEP] = best
            error[at : at + STEP] = distance[np.arange(len(codes)), best]
        return chosen, error


def _blocks(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = Block.of(whole(batch.slice(at, ROWS), 0, dims, SCALE, MOST))
                sizes = np.array([len(d) for d in block.dictionaries], "<i4")
                parts = [sizes.tobytes(), np.concatenate(block.dictionaries).astype("<i8").tobytes(), block.codes.astype("<u2").tobytes()]
                yield pa.record_batch([pa.array([p], pa.binary()) for p in parts], ["sizes", "integers", "codes"])

    return saved(mapped(rows.select(vector), packed, "sizes binary, integers binary, codes binary"), "code-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    for batch in batches:
        for sizes, integers, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]
            yield Block(np.split(np.frombuffer(integers, "<i8"), ends), np.frombuffer(codes, "<u2").reshape(-1, dims))


def _moved(blocks: DataFrame, book: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks (entries in rows, all dimensions side by side) after one round."""
    cuts, entries = _cuts(dims), len(book)

    def rows(batches):
        sums, counts = np.zeros((entries, dims), np.int64), np.zeros((entries, PARTS), np.int64)
        for block in _unpacked(batches, dims):
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                chosen, _ = block.nearest(book[:, a:b], a)
                order = np.argsort(chosen, kind="stable")
                used, starts = np.unique(chosen[order], return_index=True)
                sums[used, a:b] += np.add.reduceat(block.whole(a, b)[order], starts, axis=0)
                counts[:, p] += np.bincount(chosen, minlength=entries)
        flat = np.concatenate([sums.ravel(), counts.ravel()])
        at = np.flatnonzero(flat)
        return at, flat[at]

    found = totals(blocks, rows, "long")
    moved = book.copy()
    for e in range(entries):
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            count = int(found.get(entries * dims + e * PARTS + p, 0))
            if count:
                moved[e, a:b] = [int(found.get(e * dims + j, 0)) // count for j in range(a, b)]
    return moved


def codebooks(rows: DataFrame, vector: str, vec_id: str, dims: int) -> np.ndarray:
    """The final codebooks side by side: entry e of part p is row e in that part's dimensions."""
    first = rows.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(ENTRIES).select(vector).collect()
    book = np.clip(np.floor(np.array([r[0] for r in first], np.float64).reshape(-1, dims) * SCALE), -float(MOST), float(MOST)).astype(np.int64)
    blocks = _blocks(rows, vector, dims)
    for _ in range(ROUNDS):
        book = _moved(blocks, book, dims)
    return book


def listed(book: np.ndarray) -> str:
    """All components by part, entry and position, comma-joined."""
    cuts = _cuts(book.shape[1])
    return ",".join(str(v) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for v in book[:, a:b].ravel().tolist())


def coded(df: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, np.ndarray]:
    """The rows that count with `code` (two hex digits a part) and `error`, and the codebooks."""
    rows, dims = rows_of(df, vector)
    names = fresh(df, "code", "error")
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])
    if not dims:
        return df.sparkSession.createDataFrame([], schema), np.zeros((0, PARTS), np.int64)
    book, cuts = codebooks(rows, vector, vec_id, dims), _cuts(dims)
    kept, work = df.columns, fresh(df, "__vector")[0]
    place = len(kept)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                block = Block.of(whole(part, place, dims, SCALE, MOST))
                found = [block.nearest(book[:, a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                digits = np.stack([chosen for chosen, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = sum(e.astype(object) for _, e in found) if any(e.dtype == object for _, e in found) else sum(e for _, e in found)
                errors = [e if e < 1 << 63 else None for e in error.tolist()]
                codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    doubles = rows.withColumn(work, F.col(vector)).withColumn(vector, F.col(vector).cast(df.schema[vector].dataType))
    return mapped(doubles.select(*kept, work), encode, schema), book


def with_label_errors(rows: DataFrame, label: str, error: str, column: str = "label_error") -> DataFrame:
    """The rows with the sum of their label's errors; null labels are one label."""
    (column, same) = fresh(rows, column, "__same")
    sums = rows.groupBy(F.col(label).alias(same)).agg(F.sum(F.col(error).cast("decimal(38,0)")).alias(column))
    sums = broadcast_if_small(sums)
    joined = rows.join(sums, F.col(label).eqNullSafe(F.col(same)), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.expr(f"try_cast(`{column}` AS BIGINT)").alias(column))
