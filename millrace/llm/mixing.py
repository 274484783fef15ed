"""Mixing sources to target weights by a low-discrepancy schedule.

The texts of a source, shuffled by a hash, form one row of words that is cut into blocks of equal length. Slot n of
the mix goes to the source in whose share of [0, 1) the n-th van der Corput point lies; its rank among the source's
slots names the block it takes, and ranks past the last block begin the source anew. The rank has a closed form (how
many of the first n points lie below a bound), so the slots are made and ranked without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of one slot of the schedule.
BLOCK_WORDS = 64
#: The per-source totals are held on the driver; more sources than this are refused.
MAX_SOURCES = 100_000
_BITS = 40
_BUCKETS = 4096


def targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Split share * sum(sizes) by weight; who would get over most times its size gets that, and the excess is split again."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    active = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        active = [i for i in active if i not in set(full)]
    return out


def reversed_bits(n: np.ndarray) -> np.ndarray:
    """The van der Corput point of n in units of 2**-40: its lowest 40 bits in reverse order."""
    out, n = np.zeros(n.shape, np.uint64), n.astype(np.uint64)
    for i in range(_BITS):
        out |= ((n >> np.uint64(i)) & np.uint64(1)) << np.uint64(_BITS - 1 - i)
    return out


def points_below(n: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of the points 0 .. n-1 lie below bound (units of 2**-40), by the dyadic intervals that make up [0, bound)."""
    n, bound = n.astype(np.int64), bound.astype(np.int64)
    total = np.where(bound >> _BITS, n, 0)
    bound = np.where(bound >> _BITS, 0, bound)
    low = np.zeros(n.shape, np.int64)  # the leading bits of the bound so far, reversed
    for i in range(1, _BITS + 1):
        bit = (bound >> (_BITS - i)) & 1
        step = np.int64(1) << i
        total += np.where(bit == 1, np.maximum(n - low + step - 1, 0) >> i, 0)
        low += bit << (i - 1)
    return total


def source_key(source: Column) -> Column:
    """A text that is not null and names the source, null being one of its own."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def source_plan(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], block_words: int) -> pd.DataFrame:
    """One row per source, by code point and null last: key, words, target, blocks, and its bounds in the schedule.

    docs: key, size. The totals are summed on Spark; what comes to the driver is a row per source, MAX_SOURCES at most.
    """
    rows = docs.groupBy("key").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["key"] == "", r["key"]))
    words = [int(r["words"] or 0) for r in rows]
    goal = targets(words, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    blocks = [-(-w // block_words) for w in words]
    slots = [g * b / w if w else 0.0 for g, b, w in zip(goal, blocks, words, strict=True)]
    edges = np.concatenate([[0.0], np.cumsum(slots)])
    edges = np.round(edges / max(edges[-1], 1e-300) * 2**_BITS).astype(np.int64) if len(rows) else edges.astype(np.int64)
    return pd.DataFrame(
        {
            "idx": np.arange(len(rows)), "key": [r["key"] for r in rows], "words": words, "target": goal, "blocks": blocks,
            "low": edges[:-1], "high": edges[1:], "slots": slots,
        }
    )


def schedule(docs: DataFrame, plan: pd.DataFrame, most: float) -> DataFrame:
    """The mix in order: slot, idx (of the source), block, epoch. A slot whose rank is past ``most`` epochs is left out."""
    spark, total = docs.sparkSession, int(round(plan["slots"].sum()))
    low, high, blocks = (plan[c].to_numpy(np.int64) for c in ("low", "high", "blocks"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["id"].to_numpy(np.int64)
            at = np.searchsorted(high, reversed_bits(n).astype(np.int64), side="right")
            rank = points_below(n, high[at]) - points_below(n, low[at])
            out = pd.DataFrame({"slot": n, "idx": at, "block": rank % blocks[at], "epoch": rank // blocks[at]})
            yield out[rank < np.floor(most * blocks[at])]

    return spark.range(total).mapInPandas(place, "slot long, idx long, block long, epoch long")


def positions(docs: DataFrame, plan: pd.DataFrame, seed: int) -> DataFrame:
    """docs (key, size, id and more) with idx, n (unique within idx and bucket) and start, the words before it in its source's shuffled row."""
    spark = docs.sparkSession
    sources = spark.createDataFrame(plan[["key", "idx", "words", "target"]], "key string, idx long, words long, target double")
    dealt = docs.withColumn("_h", F.xxhash64(F.lit(seed), "id")).withColumn("_bucket", F.shiftright("_h", 52))
    before = (
        dealt.groupBy("key", "_bucket")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_base", F.sum("_sum").over(Window.partitionBy("key").orderBy("_bucket")) - F.col("_sum"))
        .drop("_sum")
    )
    within = Window.partitionBy("key", "_bucket").orderBy("_h", "id", "size")
    return (
        dealt.join(before, ["key", "_bucket"])
        .withColumn("n", F.row_number().over(within))
        .withColumn("start", F.col("_base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(sources), "key")  # MAX_SOURCES rows at most
        .drop("_h", "_base")
    )


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 17,
) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target (of its source), taken (repeats counted).

    One row per row of docs. A null text has size 0; a null source is a source of its own, and the last. Documents
    with equal ids keep a fixed order by size; repeated rows each count. An empty table gives an empty result. Every
    word lies in one block and a block is taken at most ``most`` times (whole times), so no document exceeds that. Columns beside
    the three are neither read nor returned.
    The words that a source gives differ from its target by the schedule's discrepancy, a few blocks.
    """
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            source_key(F.col(source)).alias("key"),
        )
    )  # the texts are read and counted once
    plan = source_plan(base, share, most, weights, block_words)
    placed = positions(base, plan, seed)
    uses = schedule(docs, plan, most).groupBy("idx", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut_up = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    row = ["idx", "_bucket", "n", "id", "source", "size", "words", "target"]
    return (
        cut_up.join(uses, ["idx", "block"], "left")
        .withColumn("took", F.coalesce(overlap * F.col("uses"), F.lit(0)))
        .groupBy(*row)
        .agg(F.sum("took").cast("long").alias("taken"))
        .select(F.col("id").alias(id_col), "source", "size", F.col("words").alias("source_size"), "target", "taken")
    )
