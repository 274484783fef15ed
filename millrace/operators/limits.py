"""A quota over a sliding window: which requests a server admits, and how long the refused ones are told to wait.

What a request meets depends on all before it, through the admitted requests of the last window and nothing else. So the
requests of all clients are cut into slices of one order, and each slice is judged by a task of its own. Behind a pause
of a window, or another client, nothing is left over from before. A slice without either is a map from what it meets to
what it leaves; it is worked out for every state that the requests before it allow, if these are few, and the maps are put together.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import cut

#: A slice is judged for so many states ahead of time, at most; one that may begin in more waits for the slice before it.
STATES = 256

State = tuple[int, ...]  # when the admitted requests of the last window were, in order


class Slice(NamedTuple):
    """The ends of a slice, and what it leaves: null where that depends on what it meets. tail: the requests of its last window, null if there are many."""

    slice: int
    first: object
    first_at: int
    last: object
    last_at: int
    left: list[int] | None
    tail: list[int] | None


def ask(taken: State, when: int, quota: int, window: int) -> tuple[State, int | None]:
    """What a request leaves, and how long it is told to wait if it is refused."""
    live = tuple(t for t in taken if when - t < window)
    if len(live) < quota:
        return (*live, when), None
    return live, window - (when - live[0])


def states(tail: list[int], quota: int) -> list[State] | None:
    """All that the requests of a window may have left; None if these are more than STATES."""
    sizes = range(min(quota, len(tail)) + 1)
    if sum(comb(len(tail), k) for k in sizes) > STATES:
        return None
    return sorted({c for k in sizes for c in combinations(sorted(tail), k)})


def admitted(
    calls: DataFrame, quota: int, window_us: int, client: str = "client", at: str = "at_us", number: str = "number", slices: int | None = None,
) -> DataFrame:
    """calls (client, at_us, number) with wait_us: null for a request that is admitted, else the time until one would be.

    A request is admitted if fewer than ``quota`` admitted ones of its client lie in the window up to it; refused ones
    take no quota. Requests of one moment go by number, and equal ones may stand for each other. Requests without a client or a time are left out.
    The rows are cut by range into slices of about the same size (spark.sql.shuffle.partitions of them unless given), so a client is spread over
    as many tasks as it has slices. A slice whose client never pauses, and may meet more than STATES states, is judged after the
    one before it: then there are as many rounds as such slices in a row. The driver holds the ends of the slices.
    """
    spark, kinds = calls.sparkSession, dict(calls.dtypes)
    rows = calls.select(F.col(client).alias("client"), F.col(at).cast("long").alias("at"), F.col(number).alias("number")).filter("client IS NOT NULL AND at IS NOT NULL")
    order = ["client", "at", "number"]
    ranged = rows.repartitionByRange(slices, *order) if slices else rows.repartitionByRange(*order)
    sliced = cut(ranged.withColumn("slice", F.spark_partition_id()))

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition("slice").sortWithinPartitions("slice", *order).select("slice", *order)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([first[0]], kind), pa.array([first[1]]), pa.array([who], kind), pa.array([when]), pa.array([None if taken is None else list(taken)], pa.list_(pa.int64())), pa.array([list(tail) if len(tail) < STATES else None], pa.list_(pa.int64()))],
                Slice._fields,
            )

        now = None
        for batch in batches:
            kind = batch.column(1).type
            for part, who_, when_ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    if now is not None:
                        yield made()
                    now, first, who, taken, tail = part, (who_, when_), who_, None, deque()
                elif who_ != who or when_ - when >= window_us:
                    taken, tail = (), deque()
                who, when = who_, when_
                if taken is not None:
                    taken, _ = ask(taken, when, quota, window_us)
                tail.append(when)
                while when - tail[0] >= window_us:
                    tail.popleft()
        if now is not None:
            yield made()

    kind = kinds[client]
    found = ordered(sliced).mapInArrow(ends, f"slice int, first {kind}, first_at long, last {kind}, last_at long, left array<long>, tail array<long>")
    met = _entries(ordered, sliced, [Slice(*r) for r in sorted(found.collect())], quota, window_us)
    shared = spark.sparkContext.broadcast({k: v for k, v in met.items() if v})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, taken = None, None, ()
        for batch in batches:
            waits = []
            for part, who_, when in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    now, who, taken = part, who_, shared.value.get(part, ())
                elif who_ != who:
                    who, taken = who_, ()
                taken, wait = ask(taken, when, quota, window_us)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(waits, pa.int64())], [client, at, number, "wait_us"])

    return ordered(sliced).mapInArrow(judge, f"`{client}` {kind}, `{at}` long, `{number}` {kinds[number]}, wait_us long")


def _entries(ordered, sliced: DataFrame, ends: list[Slice], quota: int, window: int) -> dict[int, State]:
    """What each slice meets."""
    met: dict[int, State] = {}
    left: dict[int, State] = {s.slice: tuple(s.left) for s in ends if s.left is not None}
    before = dict(zip([s.slice for s in ends[1:]], ends, strict=False))
    maps: dict[int, dict[State, State]] = {}
    while True:
        for s in ends:
            b = before.get(s.slice)
            if b is None or b.last != s.first or s.first_at - b.last_at >= window:
                met[s.slice] = ()
            elif b.slice in left:
                met[s.slice] = _live(left[b.slice], s.first_at, window)
            if s.slice not in left and met.get(s.slice) in maps.get(s.slice, {}):
                left[s.slice] = maps[s.slice][met[s.slice]]
        if len(met) == len(ends):
            return met
        due: dict[int, list[State]] = {}
        for s in ends:
            if s.slice not in left and s.slice in met:
                due[s.slice] = [met[s.slice]]
            elif s.slice not in left and s.slice not in maps and before[s.slice].tail is not None:
                if (allowed := states(list(_live(tuple(before[s.slice].tail), s.first_at, window)), quota)) is not None:
                    due[s.slice] = allowed
        for part, meets, leaves in _leaves(ordered, sliced, due, quota, window):
            maps.setdefault(part, {})[tuple(meets)] = tuple(leaves)


def _live(taken: State, when: int, window: int) -> State:
    return tuple(t for t in taken if when - t < window)


def _leaves(ordered, sliced: DataFrame, due: dict[int, list[State]], quota: int, window: int) -> list:
    """(slice, meets, leaves) for the states of the slices; states that have become the same are followed as one."""
    shared = sliced.sparkSession.sparkContext.broadcast(due)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            meets = [m for group in groups.values() for m in group]
            leaves = [list(s) for s, group in groups.items() for _ in group]
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([now] * len(meets), pa.int32()), pa.array([list(m) for m in meets], lists), pa.array(leaves, lists)], ["slice", "meets", "leaves"])

        now, groups = None, {}
        for batch in batches:
            for part, when in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield made()
                    now, groups = part, {s: [s] for s in shared.value[part]}
                after: dict[State, list[State]] = {}
                for s, group in groups.items():
                    after.setdefault(ask(s, when, quota, window)[0], []).extend(group)
                groups = after
        if now is not None:
            yield made()

    listed = [int(k) for k in due]
    rows = sliced.join(F.broadcast(sliced.sparkSession.createDataFrame([(k,) for k in listed], "slice int")), "slice")
    return [tuple(r) for r in ordered(rows).mapInArrow(follow, "slice int, meets array<long>, leaves array<long>").collect()]
