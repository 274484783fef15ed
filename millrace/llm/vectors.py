"""Vectors of one length, read from Arrow as matrices of whole numbers, and sums of what partitions found."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix at most, so that sums of numbers below EXACT fit a long.
ROWS, EXACT = 4096, 1 << 48


def sound(vec: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def common_length(vectors: DataFrame, vector: str) -> int:
    """The length that most sound vectors have (of several such, the greatest); 0 where there is none."""
    vec = F.col(vector).cast("array<double>")
    found = vectors.filter(sound(vec)).groupBy(F.size(vec).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found["dims"] if found else 0


def matrices(batches: Iterator[pa.RecordBatch], dims: int, scale: int, shift: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows whose first column is a vector of so many finite numbers, and floor(scale * number) + shift of them as longs."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(0)), dims), False))
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[fine])
            if x.size and np.abs(x).max() + shift >= EXACT:
                raise ValueError(f"numbers of {EXACT // scale} and more are too large to be counted exactly")
            if len(x):
                yield batch.filter(pa.array(fine)), x.astype(np.int64) + shift


def added(parts: DataFrame, add):
    """What the pickles in the first column come to when they are merged by add, in a tree; None where there are none."""

    def both(a, b):
        return b if a is None else a if b is None else add(a, b)

    return parts.rdd.map(lambda row: pickle.loads(row[0])).treeAggregate(None, both, both)


def pickled(value) -> pa.RecordBatch:
    """A batch of one row and column, for ``added``."""
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["part"])
