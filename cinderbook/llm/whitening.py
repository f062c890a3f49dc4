"""Whitening of vectors by Chebyshev-filtered subspace iteration over distributed covariance products.

Entries become whole numbers, x = floor(SCALE * entry).  Each distinct x vector counts once; the distinct vectors are kept as
blocks of bytes in the shared folder.  A pass multiplies their covariance V with a thin matrix Q: every block is centred, then
XtXQ is added up in Spark.  V itself is never formed.

A cycle: the Ritz vectors of the block (WANTED + GUARDS columns) go through a Chebyshev polynomial of V, evaluated by its
three-term recurrence, a pass a degree, that damps the spectrum between `low` and the smallest Ritz value; then QR, one more
pass and Rayleigh-Ritz.  `low` comes from a Lanczos run beside the first cycle, on a column of its own in the same passes.  The
iteration ends once the residuals |Vu - eu| of the wanted pairs are below TOLERANCE of the largest eigenvalue: that is the
certificate.  If PATIENCE passes do not get there, the block doubles, up to all dimensions, where Rayleigh-Ritz is exact.

Defined results: rows that do not count (see `vectors`) are left out; entries beyond 2^53 / SCALE count as that; repeated rows
are all returned, in the fit they count once; components without variance are left out, so a table of one distinct vector
gives no row, as an empty table does; equal eigenvalues leave the choice of their vectors open; `deviation` is null where it
needs more than a long; the vector itself is not returned, other columns pass through, and added ones get a name of their own
where the table has it already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbook.llm.common import fresh, mapped, saved
from cinderbook.llm.vectors import KINDS, narrow, rows_of, totals, whole

SCALE = 256
MOST = 1 << 53
WANTED, GUARDS = 4, 16
FIRST, DEGREE = 10, 24  # degree of the first cycle, and of a later one at most
SPREAD = 1e6  # by which a cycle may amplify the first wanted component more than the last
TOLERANCE = 2.0**-44
PATIENCE = 150
SLICE = 4096


@dataclass
class Fit:
    """n distinct vectors, their sums by dimension, the leading eigenpairs of their covariance and how well they hold."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _blocks(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Each distinct x vector once, in blocks: n, kind (of KINDS), data."""
    place = rows.columns.index(vector)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch, place, dims, SCALE, MOST)
            size = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.zeros(0)
            kinds = np.searchsorted([np.iinfo(k).max for k in KINDS], size)
            out = np.empty(len(x), dtype=object)
            for k in np.unique(kinds):
                for i, row in zip(np.flatnonzero(kinds == k), x[kinds == k].astype(KINDS[k]), strict=True):
                    out[i] = bytes([k]) + row.tobytes()
            yield pa.record_batch([pa.array(out, pa.binary())], ["x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v, KINDS[v[0]], offset=1).astype(np.int64) for v in batch.column(0).to_pylist()])
                k = narrow(x)
                yield pa.record_batch(
                    [pa.array([len(x)], pa.int64()), pa.array([k], pa.int32()), pa.array([x.astype(KINDS[k]).tobytes()], pa.binary())],
                    ["n", "kind", "data"],
                )

    distinct = mapped(rows, keys, "x binary").distinct()
    return saved(mapped(distinct, packed, "n long, kind int, data binary"), "whitening-blocks")


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            x = np.frombuffer(data, KINDS[kind]).reshape(-1, dims)
            for at in range(0, len(x), SLICE):
                yield x[at : at + SLICE]


def _sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number and exact sums: high and low halves are added apart, so that no sum of a task overflows."""

    def rows(batches):
        out = np.zeros(2 * dims + 1, np.int64)
        for x in _matrices(batches, dims):
            x = x.astype(np.int64)
            out[:dims] += (x >> 32).sum(axis=0)
            out[dims:-1] += (x & 0xFFFFFFFF).sum(axis=0)
            out[-1] += len(x)
        return np.arange(len(out)), out

    found = totals(blocks, rows, "long")
    return int(found.get(2 * dims, 0)), [(int(found.get(j, 0)) << 32) + int(found.get(dims + j, 0)) for j in range(dims)]


class Covariance:
    """Products of the covariance with thin matrices, a pass over the blocks each."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, mean: np.ndarray):
        self.blocks, self.dims, self.n, self.mean, self.trace, self.passes = blocks, dims, n, mean, None, 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        dims, mean, n_columns = self.dims, self.mean, q.shape[1]

        def rows(batches):
            out, trace = np.zeros((dims, n_columns)), 0.0
            for x in _matrices(batches, dims):
                c = x - mean
                out += c.T @ (c @ q)
                trace += float(np.einsum("ij,ij->", c, c))
            return np.arange(out.size + 1), np.append(out.ravel(), trace)

        found = totals(self.blocks, rows, "double")
        self.passes += 1
        self.trace = found[dims * n_columns] / self.n
        return np.array([found[i] for i in range(dims * n_columns)]).reshape(dims, n_columns) / self.n


class _Lanczos:
    """A lower bound of the spectrum from a few steps on one column."""

    def __init__(self, dims: int, rng):
        v = rng.standard_normal(dims)
        self.basis, self.diagonal, self.beside, self.done = [v / np.linalg.norm(v)], [], [], False

    def column(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def step(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.diagonal.append(float(v @ product))
        w = product
        for _ in range(2):
            for b in self.basis:
                w = w - (b @ w) * b
        self.beside.append(float(np.linalg.norm(w)))
        self.basis.append(w / self.beside[-1] if self.beside[-1] > 1e-12 * abs(self.diagonal[0]) else np.zeros_like(w))

    def low(self) -> float:
        t = np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beside[-1])


def _ritz(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = q.T @ product
    values, turn = np.linalg.eigh((t + t.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, product @ turn


def leading(covariance: Covariance, wanted: int = WANTED, guards: int = GUARDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, unit eigenvectors (columns) and the largest residual relative to the largest eigenvalue."""
    dims, rng = covariance.dims, np.random.default_rng(seed)
    wanted, width, low, lanczos = min(wanted, dims), min(dims, wanted + guards), 0.0, None
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    values, q, product = _ritz(q, covariance @ q)
    since, exact = 0, 0
    while True:
        residuals = np.linalg.norm(product[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        worst = float(residuals.max() / values[0]) if values[0] > 0 else 0.0
        exact += width == dims
        if worst <= TOLERANCE or exact > 2:
            return values[:wanted], q[:, :wanted], worst
        if since > PATIENCE and width < dims:
            more = rng.standard_normal((dims, min(width, dims - width)))
            q = np.linalg.qr(np.hstack([q, more]))[0]
            values, q, product = _ritz(q, covariance @ q)
            width, since = q.shape[1], 0
            continue
        # The damped interval is mapped to [-1, 1]; where the wanted values lie there tells the degree.
        high = float(values[-1])
        low = min(low, 0.999 * high)
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-3 * values[0])
        place = np.arccosh(np.maximum((values[[0, wanted - 1]] - centre) / half, 1 + 1e-9))
        if lanczos is None:
            lanczos, degree = _Lanczos(dims, rng), min(FIRST, dims)
        else:
            needed = np.log(max(worst / TOLERANCE, 2) * 8) / max(place[1], 1e-3)
            allowed = np.log(SPREAD) / max(place[0] - place[1], 1e-9)
            degree = int(np.clip(np.ceil(min(needed, allowed)), 2, DEGREE))
        first = sigma = half / max(values[0] - centre, half)
        before, now = q, (product - centre * q) * (sigma / half)
        for step in range(degree):
            if step:
                columns = now if lanczos.done else np.hstack([now, lanczos.column()])
                got = covariance @ columns
                if columns is not now:
                    lanczos.step(got[:, -1])
                    got = got[:, :-1]
                after = 1 / (2 / first - sigma)
                before, now = now, 2 * (after / half) * (got - centre * now) - sigma * after * before
                sigma = after
        if not lanczos.done:
            low, lanczos.done = lanczos.low() if lanczos.diagonal else 0.0, True
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        values, q, product = _ritz(q, covariance @ q)
        since += degree


def fit(df: DataFrame, vector: str) -> Fit | None:
    """The components of the rows that count; None without any."""
    rows, dims = rows_of(df.select(vector), vector)
    return _fit(rows, vector, dims) if dims else None


def _fit(rows: DataFrame, vector: str, dims: int) -> Fit:
    blocks = _blocks(rows.select(vector), vector, dims)
    n, sums = _sums(blocks, dims)
    covariance = Covariance(blocks, dims, n, np.array([s / n for s in sums]))
    values, vectors, residual = leading(covariance)
    some = values > 64 * dims * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    found = Fit(n, sums, values, vectors, covariance.trace, residual, 0.0, covariance.passes)
    if len(values):
        found.identity_error = _identity_error(blocks, dims, found)
    return found


def _identity_error(blocks: DataFrame, dims: int, found: Fit) -> float:
    """From the whitened vectors themselves: their covariance against the identity."""
    mean, turn, k = found.mean, found.vectors / np.sqrt(found.values), len(found.values)

    def rows(batches):
        out = np.zeros((k, k))
        for x in _matrices(batches, dims):
            w = (x - mean) @ turn
            out += w.T @ w
        return np.arange(k * k), out.ravel()

    got = totals(blocks, rows, "double")
    return float(np.abs(np.array([got[i] for i in range(k * k)]).reshape(k, k) / found.n - np.eye(k)).max())


ADDED = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}


def whitened(df: DataFrame, vector: str) -> DataFrame:
    """A row for each row that counts and each component: its other columns and those in ADDED."""
    rows, dims = rows_of(df, vector)
    others = [f for f in df.schema.fields if f.name != vector]
    schema = T.StructType([*others, *[T.StructField(c, kind) for c, kind in zip(fresh(df.drop(vector), *ADDED), ADDED.values(), strict=True)]])
    found = _fit(rows, vector, dims) if dims else None
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    place, kept = rows.columns.index(vector), [i for i, c in enumerate(rows.columns) if c != vector]
    n, k, mean, turn = found.n, len(found.values), found.mean, found.vectors / np.sqrt(found.values)
    # Modulo 2^64 whole numbers are exact as long as the result itself fits.
    sums = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in found.sums], np.int64)
    explained, error = found.values / found.trace, found.identity_error
    n_wrapped = np.int64((n + (1 << 63)) % (1 << 64) - (1 << 63))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = whole(part, place, dims, SCALE, MOST)
                c = x - mean
                with np.errstate(over="ignore"):
                    off = x * n_wrapped - sums
                    deviation = (off * off).sum(axis=1)
                fits = n * n * np.einsum("ij,ij->i", c, c) < 9.2e18
                again = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).take(pa.array(again)) for i in kept],
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(again), n, np.int64)),
                        pa.array(deviation[again], mask=~fits[again]),
                        pa.array((c @ turn).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(again), error)),
                    ],
                    names=schema.names,
                )

    return mapped(rows, project, schema)
