"""What the training-data operators share: reading tables, bounded batches, sorted groups, and lineage and checked broadcasts of the library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import cut, shared_dir, small_or_plain

__all__ = ["SMALL_BATCH_BYTES", "cut", "first_by_hash", "fresh", "join_counted", "shared_dir", "small_or_plain", "sorted_groups", "starts", "table", "text_batches"]

#: One word of a text: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts; where what is made of a batch is not summed up for it, fewer do as well.
BATCH_BYTES, SMALL_BATCH_BYTES = "8m", "2m"


def text_batches(df: DataFrame, size: str = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of a few MB at most, so that a worker's memory does not depend on how long texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns (which Spark tells apart without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def first_by_hash(df: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the least hash (a long, spread evenly). The rest are filtered out by a bound on the hash first, so that
    what the sort gets does not grow with df. Reads df twice."""
    n = df.count()
    share = (rows + 8 * math.sqrt(rows) + 8) / n if n else 1.0
    if share < 1:
        df = df.filter(F.col(hash_col) <= int(share * 2.0**64) - (1 << 63))
    return df.orderBy(hash_col).limit(rows)


#: A key of more than so many rows, and of more than this share of all, is joined by a broadcast; there are at most 1 / HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """The inner join of left with right, which has one row for each key and in ``n`` how many rows of left have it; ``rows``: all of left.

    Rows of frequent keys stay where they are and meet a broadcast of those keys' rows, 1 / HOT_SHARE at most; no key
    that is shuffled has more than that share of left.
    """
    hot = F.col(n) > max(HOT_ROWS, int(rows * HOT_SHARE))
    many = F.broadcast(right.filter(hot).drop(n))
    rest = left.join(many.select(key), key, "left_anti").join(right.filter(~hot).drop(n), key)
    return left.join(many, key).unionByName(rest)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a partition that is sorted by keys into tables that hold whole groups, many small groups to a table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and not _same(rest[0], batch, keys):
            edge = _first_of_last(batch, keys)
            if edge:
                yield pa.Table.from_batches([*rest, batch.slice(0, edge)])
                rest = [batch.slice(edge)]
                continue
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    """Whether the last row of b still belongs to the group that a's first row began."""
    return all(a.column(k)[0] == b.column(k)[-1] for k in keys)


def _first_of_last(batch: pa.RecordBatch, keys: list[str]) -> int:
    """The row where the last group of the batch begins."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(change)
    return int(at[-1]) if len(at) else 0


def starts(columns: list[np.ndarray]) -> np.ndarray:
    """The rows where a new group begins, over columns that are sorted together."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
