"""Codes of vectors by product quantisation, the codebooks fitted by Lloyd's rounds over heaps.

Vectors are packed into blocks. In a block every entry of a codebook has a heap of its parts, keyed by how much nearer
they are to it than to any other entry (lower less upper bound) plus the drift of the entry when that was found. The
drift adds up how far the entry and the fastest of the others have moved. A part can only change its entry if its key
is not above the drift, so a round pops those and no more, compares each with all entries exactly, and pushes it into
the heap of the nearest. Blocks with their heaps are written to the shared folder after each round, along with what
the round changes in the sums of the entries.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import drop
from millrace.llm.common import cut, fresh, join_counted, text_batches
from millrace.llm.vectors import added, common_length, matrices

#: Drifts are raised and keys lowered by these shares, so that rounding never hides a part that may change.
ROUNDING, LEAST = 1e-9, 1e-6


@dataclass
class Codebooks:
    """entries: part, entry, position; drift: part, entry."""

    entries: np.ndarray
    drift: np.ndarray

    def bounds(self) -> np.ndarray:
        """Keys up to these may be wrong."""
        return self.drift * (1 + ROUNDING) + LEAST

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """With every used entry at the floor of its mean, and what the entries moved added to the drift."""
        entries = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        others = np.array([[np.delete(row, e).max(initial=0.0) for e in range(len(row))] for row in step]).reshape(step.shape)
        return Codebooks(entries, self.drift + step + others)

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the first of several), and by how much the next is farther, rather too little than too much."""
    d = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    own = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(d)), own].astype(np.float64))
    if len(entries) == 1:
        return own, np.full(len(x), np.inf)
    d[np.arange(len(d)), own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(np.float64))
    return own, lower - upper - ROUNDING * (lower + upper)


class Block:
    """Parts of some vectors (row, part, position), and for each part the heaps of all entries, one after the other."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.x, self.keys, self.rows, self.sizes = x, keys, rows, sizes

    @classmethod
    def first(cls, x: np.ndarray, books: Codebooks) -> Block:
        """Every part compared with every entry; rows in the order of their keys are a heap."""
        n, parts, entries = len(x), x.shape[1], books.entries.shape[1]
        out = cls(x, np.empty((parts, n)), np.empty((parts, n), np.int32), np.empty((parts, entries), np.int32))
        for p in range(parts):
            own, gap = nearest(x[:, p], books.entries[p])
            key = gap + books.drift[p, own]
            order = np.lexsort((key, own))
            out.keys[p], out.rows[p], out.sizes[p] = key[order], order, np.bincount(own, minlength=entries)
        return out

    def heap(self, part: int, entry: int) -> list[tuple[float, int]]:
        end = int(self.sizes[part, : entry + 1].sum())
        at = slice(end - int(self.sizes[part, entry]), end)
        return list(zip(self.keys[part, at].tolist(), self.rows[part, at].tolist(), strict=True))

    def codes(self) -> np.ndarray:
        """The entry of each row and part."""
        out = np.empty(self.x.shape[:2], np.int64)
        for p, sizes in enumerate(self.sizes):
            out[self.rows[p], p] = np.repeat(np.arange(len(sizes)), sizes)
        return out

    def reassign(self, books: Codebooks, change: Change) -> None:
        """Pop the parts that may have another nearest entry now, and push each where it belongs."""
        bounds = books.bounds()
        for p in range(self.x.shape[1]):
            ends = np.cumsum(self.sizes[p])
            tops = np.where(self.sizes[p] > 0, self.keys[p, np.minimum(ends - self.sizes[p], len(self.x) - 1)], np.inf)
            heaps, popped, left = {}, [], []
            for e in np.flatnonzero(tops <= bounds[p]).tolist():
                heaps[e] = heap = self.heap(p, e)
                while heap and heap[0][0] <= bounds[p, e]:
                    popped.append(heapq.heappop(heap)[1])
                    left.append(e)
            if not popped:
                continue
            at, left = np.array(popped), np.array(left)
            own, gap = nearest(self.x[at, p], books.entries[p])
            for row, e, key in zip(popped, own.tolist(), (gap + books.drift[p, own]).tolist(), strict=True):
                if e not in heaps:
                    heaps[e] = self.heap(p, e)
                heapq.heappush(heaps[e], (key, row))
            all_heaps = [heaps[e] if e in heaps else self.heap(p, e) for e in range(len(self.sizes[p]))]
            self.sizes[p] = [len(h) for h in all_heaps]
            self.keys[p] = [key for h in all_heaps for key, _ in h]
            self.rows[p] = [row for h in all_heaps for _, row in h]
            other = own != left
            change.move(p, self.x[at[other], p], own[other], left[other])

    def errors(self, books: Codebooks) -> np.ndarray:
        """The squared distances of each row's parts from their entries, added up."""
        codes = self.codes()
        return sum(((self.x[:, p] - books.entries[p, codes[:, p]]) ** 2).sum(axis=1) for p in range(self.x.shape[1]))


class Change:
    """What a partition adds to the sums and counts of the entries."""

    def __init__(self, shape: tuple[int, int, int]) -> None:
        self.sums, self.counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)

    def move(self, part: int, x: np.ndarray, to: np.ndarray, off: np.ndarray | None = None) -> None:
        for sign, entry in ((1, to), (-1, off)):
            if entry is not None:
                np.add.at(self.sums[part], entry, sign * x)
                np.add.at(self.counts[part], entry, sign)


_STATE = "dims int, x binary, keys binary, places binary, sizes binary, part binary"


def _packed(ids: pa.Array, labels: pa.Array, block: Block) -> pa.RecordBatch:
    small = next(t for t in (np.int16, np.int32, np.int64) if block.x.size == 0 or np.abs(block.x).max() <= np.iinfo(t).max)
    one = lambda v: pa.array([v.tobytes()], pa.binary())
    ends = pa.array([0, len(block.x)], pa.int32())
    rest = [one(block.x.astype(small)), one(block.keys), one(block.rows), one(block.sizes), pa.nulls(1, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([block.x.shape[1] * block.x.shape[2]], pa.int32()), *rest],
        ["ids", "labels", "dims", "x", "keys", "places", "sizes", "part"],
    )


def _unpacked(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
    for i in range(batch.num_rows):
        dims, x, keys, places, sizes = (batch.column(k)[i].as_py() for k in ("dims", "x", "keys", "places", "sizes"))
        n = len(keys) // (8 * parts)
        whole = np.frombuffer(x, f"i{len(x) // (n * dims)}").astype(np.int64).reshape(n, parts, dims // parts)
        heaps = np.frombuffer(keys).reshape(parts, n).copy(), np.frombuffer(places, np.int32).reshape(parts, n).copy()
        yield batch.column("ids")[i].values, batch.column("labels")[i].values, Block(whole, *heaps, np.frombuffer(sizes, np.int32).reshape(parts, -1).copy())


def _changes(change: Change, like: pa.Schema) -> pa.RecordBatch:
    """A row of nulls but for the changes, the last of a partition."""
    return pa.RecordBatch.from_arrays(
        [pa.array([pickle.dumps((change.sums, change.counts))], pa.binary()) if f.name == "part" else pa.nulls(1, f.type) for f in like], schema=like
    )


def encode(
    vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error) of each sound vector, and the final codebooks. code: a byte for each part.

    A component c counts as floor(scale * c). The codebooks start from the vectors of the smallest ids (nulls last; among equal
    ids the lesser vector first), fewer than ``entries`` if there are fewer vectors. Dropped are vectors that are null or empty,
    that hold null or non-finite numbers, or that are not of the commonest length, which must be a multiple of ``parts``; an
    empty table gives an empty result and empty codebooks. Repeated rows count as often as they occur, and of entries at the same
    distance the first wins. Null ids and labels are kept. Components of 2^28 / scale and more are refused. Other columns are neither read nor returned.
    """
    text_batches(vectors)
    kinds = dict(vectors.dtypes)
    dims = common_length(vectors, vector)
    if dims % parts:
        raise ValueError(f"vectors of {dims} numbers cannot be cut into {parts} equal parts")
    width = dims // parts
    id_, label_ = fresh(vectors.select(vector), "id", "label")
    read = vectors.select(F.col(vector).cast("array<double>").alias(vector), F.col(id_col).alias(id_), F.col(label).alias(label_))
    coded = f"`{id_col}` {kinds[id_col]}, `{label}` {kinds[label]}, code binary, error long"
    if not dims:
        return vectors.sparkSession.createDataFrame([], coded), Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for rows, x in matrices(batches, dims, scale):
            if np.abs(x).max() >= 1 << 28:
                raise ValueError(f"numbers of {(1 << 28) // scale} and more are too large for exact distances")
            yield rows, x.reshape(len(x), parts, width)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in whole(batches):
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(1), lists], ["id", "x"])

    earliest = read.mapInArrow(numbers, f"id {kinds[id_col]}, x array<long>").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries)
    start = np.array([r["x"] for r in earliest.collect()], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    books = Codebooks(start, np.zeros(start.shape[:2]))
    spark = vectors.sparkSession
    state_kind = f"ids array<{kinds[id_col]}>, labels array<{kinds[label]}>, {_STATE}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, change, like = shared.value, Change(start.shape), None
        for rows, x in whole(batches):
            block = Block.first(x, now)
            codes = block.codes()
            for p in range(parts):
                change.move(p, x[:, p], codes[:, p])
            out = _packed(rows.column(1), rows.column(2), block)
            like = out.schema
            yield out
        if like is not None:
            yield _changes(change, like)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, change, like = shared.value, Change(start.shape), None
        for batch in batches:
            for ids, labels, block in _unpacked(batch, parts):
                block.reassign(now, change)
                out = _packed(ids, labels, block)
                like = out.schema
                yield out
        if like is not None:
            yield _changes(change, like)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for ids, labels, block in _unpacked(batch, parts):
                block.reassign(now, Change(start.shape))
                code = [row.tobytes() for row in block.codes().astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.binary()), pa.array(block.errors(now))], [id_col, label, "code", "error"])

    shared = spark.sparkContext.broadcast(books)
    state = cut(read.mapInArrow(first, state_kind))
    sums, counts = np.zeros(start.shape, np.int64), np.zeros(start.shape[:2], np.int64)
    for done in range(1, rounds + 1):
        more = added(state.filter("part IS NOT NULL").select("part"), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        sums, counts = sums + more[0], counts + more[1]
        moved = books.moved(sums, counts)
        still, books = bool((moved.entries == books.entries).all()), moved
        shared = spark.sparkContext.broadcast(books)
        if still or done == rounds:
            break
        before, state = state, cut(state.filter("part IS NULL").mapInArrow(again, state_kind))
        drop(before)
    result = cut(state.filter("part IS NULL").mapInArrow(last, coded))
    drop(state)
    return result, books


def with_label_errors(coded: DataFrame, *, label: str = "label") -> DataFrame:
    """coded with label_error, the errors of equal labels (nulls together) added up; a label with a large share of the rows is not shuffled."""
    key, n = fresh(coded, "_key", "_n")
    keyed = coded.withColumn(key, F.struct(F.col(label).isNull().alias("none"), F.col(label).alias("value")))
    sums = cut(keyed.groupBy(key).agg(F.sum("error").alias("label_error"), F.count("*").alias(n)))
    return join_counted(keyed, sums, key, n, coded.count()).drop(key)
