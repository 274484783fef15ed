"""Whitening of embeddings by a two-pass covariance.

The first pass adds up whole numbers exactly, which gives the mean; the second adds up the outer products of the
centred vectors, a matrix product for each batch. Both merge in a tree. The eigenvectors of the covariance come from
LAPACK on the driver, and their projection goes to all executors, dims x components numbers. A third pass measures the
covariance of what the projection gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_batches
from millrace.llm.vectors import added, common_length, matrices, pickled

#: Longer vectors are refused, as the driver holds a matrix of so many rows and columns.
MAX_DIMS = 4096
#: An eigenvalue below this share of the greatest, times the dimensions, is taken for zero.
ZERO = 1e-14


@dataclass(frozen=True)
class Whitening:
    """n vectors of whole numbers floor(scale * c) + shift have the sums; a column of axes is a component, in the order of values."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float = 0.0

    def known(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > (ZERO * len(self.sums) * self.values.max(initial=0.0))

    def explained(self) -> list[float]:
        return [float(max(v, 0.0) / self.trace) if self.trace > 0 else 0.0 for v in self.values]

    def projection(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.known(), self.axes / np.sqrt(np.maximum(self.values, 0)), 0.0)

    def project(self, vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """id, deviation (decimal), whitened (an array with a number for each component; null for one without variance)."""
        kind = dict(vectors.dtypes)[id_col]
        shared = vectors.sparkSession.sparkContext.broadcast((self.n, self.sums, self.projection(), self.known(), self.scale, self.shift))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, axes, known, scale, shift = shared.value
            for rows, x in matrices(batches, len(sums), scale, shift):
                off = deviations(x, n, sums)
                white = (off.astype(np.float64) / n) @ axes
                flat = pa.array(white.ravel(), mask=np.broadcast_to(~known, white.shape).ravel())
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(known), flat)
                yield pa.RecordBatch.from_arrays([rows.column(1), _squares(off), lists], [id_col, "deviation", "whitened"])

        text_batches(vectors)
        read = vectors.select(F.col(vector).cast("array<double>"), F.col(id_col))
        return read.mapInArrow(scan, f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>")


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: longs, or Python's integers where they might not fit."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(off: np.ndarray) -> pa.Array:
    """The sums of the squares of each row, exactly."""
    if off.dtype == object or off.shape[1] * int(np.abs(off).max(initial=0)) ** 2 >= 1 << 62:
        return pa.array(list((off.astype(object) ** 2).sum(axis=1)), pa.decimal128(38, 0))
    return pa.array((off**2).sum(axis=1)).cast(pa.decimal128(38, 0))


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The components of the greatest variance of all sound vectors of the commonest length; None where there are none.

    A component points where the number of its greatest size is positive. Reads the vectors four times.
    """
    text_batches(vectors)
    dims = common_length(vectors, vector)
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} numbers; at most {MAX_DIMS} are supported")
    if not dims:
        return None
    read = vectors.select(F.col(vector).cast("array<double>"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for _, x in matrices(batches, dims, scale, shift):
            n, sums = n + len(x), sums + x.sum(axis=0).astype(object)  # Python's integers, which have no end
        yield pickled((n, sums))

    n, sums = added(read.mapInArrow(total, "part binary"), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    sums = tuple(int(s) for s in sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims))
        for _, x in matrices(batches, dims, scale, shift):
            off = deviations(x, n, sums).astype(np.float64) / n
            out += off.T @ off
        yield pickled(out)

    covariance = added(read.mapInArrow(products, "part binary"), np.add) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    found = Whitening(n, sums, axes, values, float(np.trace(covariance)), scale, shift)
    shared = vectors.sparkSession.sparkContext.broadcast(found.projection())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in matrices(batches, dims, scale, shift):
            white = (deviations(x, n, sums).astype(np.float64) / n) @ shared.value
            mean = white.mean(axis=0)
            yield pickled((len(x), mean, (white - mean).T @ (white - mean)))

    m2 = added(read.mapInArrow(spread, "part binary"), _merged)[2]
    known = found.known()
    error = np.abs(m2 / n - np.eye(len(values)))[np.ix_(known, known)].max(initial=0.0)
    return Whitening(n, sums, axes, values, found.trace, scale, shift, float(error))


def _merged(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each sound vector and component.

    Dropped are vectors that are null or empty, that hold null or non-finite numbers, or that are not of the commonest
    length; an empty table gives an empty result. There are at most as many components as numbers in a vector. A
    component without variance (fewer different vectors than that) has a null in ``whitened`` and is left out of
    identity_error. Repeated rows count as often as they occur and ties among eigenvalues are as LAPACK breaks them;
    null ids are kept; other columns are neither read nor returned. Numbers of 2^48 / scale and more are refused.
    """
    model = fit(vectors, vector=vector, components=components, scale=scale, shift=shift)
    schema = f"`{id_col}` {dict(vectors.dtypes)[id_col]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = model.project(vectors, id_col=id_col, vector=vector).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(v) for v in model.explained()])
    return rows.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
