"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Test items are partitioned by how many shingles they have, in powers of two. In a partition of up to u shingles, an
item's MinHash sketch holds its u - ceil(t * u) + 1 least shingle hashes: a document that contains at least t of the
item's shingles lacks too few of them to lack more than a known number of the sketch. A document's sketch, however long it
is, holds its hashes up to the greatest of all items' sketches, less those that one bitmap of these rules out; the
partitions have no bounds of their own. Sketches are joined by hash, and who shares enough of a sketch is verified on its full shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, small_or_plain, text_batches
from millrace.llm.windows import chunks

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Items that are sent to all executors with their texts, at most; more are joined by a shuffle.
ITEM_ROWS = 20_000
#: The bitmap's slots, as a power of two; its size does not depend on the items.
FILTER_BITS = 24


def _plain(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass").lower()


def shingle_set(data: bytes, width: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct runs of ``width`` words, or the whole sequence of fewer; none of a blank text."""
    words = data.split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def sketch_size(shingles: int, t: float) -> int:
    """Least hashes kept of an item, by the upper bound of its partition."""
    most = (1 << shingles.bit_length()) - 1
    return min(shingles, most - math.ceil(t * most - 1e-9) + 1)


def least_shared(shingles: int, t: float) -> int:
    """How many hashes of its sketch an item shares at least with what contains it."""
    return max(1, sketch_size(shingles, t) - (shingles - math.ceil(t * shingles - 1e-9)))


def item_sketches(items: DataFrame, item_id: str, text: str, width: int, t: float) -> DataFrame:
    """key, item, partition, n (shingles), need (hashes to share), sketch (hashes) and text of each item that has words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, value in enumerate(batch.column(1).to_pylist()):
                own = shingle_set(_plain(value), width)
                if own:
                    hashes = np.unique(_hashes_of(own, width))[: sketch_size(len(own), t)]
                    rows.append((at, len(own).bit_length(), len(own), least_shared(len(own), t), hashes.view(np.int64).tolist(), value))
            kept = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays(kept + columns, ["item", "partition", "n", "need", "sketch", "text"])

    kind = dict(items.dtypes)[item_id]
    found = items.select(item_id, text).mapInArrow(scan, f"item {kind}, partition int, n int, need int, sketch array<long>, text string")
    return found.withColumn("key", F.monotonically_increasing_id())


def _hashes_of(shingles: set[bytes], width: int) -> np.ndarray:
    return np.concatenate([c.hashes(width, whole=True)[1] for c in chunks(shingles, width - 1)])


def bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The slots of all hashes (by their leading bits) as words of 64; summed on Spark, 2 ** bits in all. hashes: h."""
    slot = F.expr(f"shiftrightunsigned(h, {64 - bits})")
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _sketched(shared, width: int, bits: int):
    """id, th, h: the hashes of each document's sketch, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, greatest = shared.value
        for batch in batches:
            doc, held = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for c in chunks([_plain(v) for v in batch.column(2).to_pylist()], width - 1):
                first, h = c.hashes(width, whole=True)
                slot = h >> np.uint64(64 - bits)
                at = np.flatnonzero((h <= greatest) & (slots[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0))
                doc.append(c.text[c.piece[first[at]]])
                held.append(h[at])
            pairs = np.unique(np.stack([np.concatenate(doc).astype(np.uint64), np.concatenate(held)]), axis=1)
            at = pa.array(pairs[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pairs[1].view(np.int64))], ["id", "th", "h"])

    return scan


def _verified(width: int, t: float, names: list[str]):
    """Per document, whose rows stand together: its text first, as often as it occurs, then the items that it may contain."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, copies, have, items = None, 0, set(), {}
        for batch in batches:
            rows = []
            for at, (th, text, key, item_text, group) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("th", "text", "key", "item_text", "group")), strict=True)):
                own = (group, th, batch.column("id")[at])
                if key is None:
                    copies = copies + 1 if own == now else 1
                    if own != now:
                        now, have = own, shingle_set(_plain(text), width)
                    continue
                if len(items) > 5000:
                    items.clear()
                if key not in items:
                    items[key] = shingle_set(_plain(item_text), width)
                n, found = len(items[key]), sum(s in have for s in items[key])
                if own == now and found >= t * n - 1e-9:
                    rows += [(at, n, found)] * copies
            if rows:
                at, n, found = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                part = pa.array(np.divide(found.to_numpy(), n.to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("item").take(at), n, found, part], names)

    return scan


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
    width: int = SHINGLE_WORDS, t: float = CONTAINMENT, bits: int = FILTER_BITS,
) -> DataFrame:
    """A row for each document and item of which it contains at least t: id, item, n_shingles, n_found, containment.

    A-Z is lower-cased and words part at ASCII white space. A text of fewer than ``width`` words is one shingle; a null
    or blank one has none and meets nothing. Repeated documents and items each give their rows; null ids are carried;
    ties need no rule, as every pair counts. The texts are read once for their sketches, and those of candidates once
    more. With no items or no documents the result is empty; other columns are neither read nor returned.
    """
    text_batches(docs)
    spark, kinds = docs.sparkSession, (dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id])
    schema = f"{id_col} {kinds[0]}, {item_id} {kinds[1]}, n_shingles long, n_found long, containment double"
    sketched = cut(item_sketches(items, item_id, item_text, width, t))
    hashes = sketched.select("key", "need", F.explode("sketch").alias("h"))
    # as unsigned numbers the hashes sort like this
    top = hashes.agg(F.max(F.expr("h ^ cast(-9223372036854775808 as bigint)")).alias("h")).first()["h"]
    if top is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((bitmap(hashes, bits), np.uint64(top + (1 << 63))))  # of fixed size
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    met = base.select("id", "th", "text").mapInArrow(_sketched(shared, width, bits), f"id {kinds[0]}, th long, h long")
    pairs = cut(
        met.join(small_or_plain(hashes), "h").groupBy("id", "th", "key").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        .filter("n >= need").select("id", "th", "key")
    )
    wanted = small_or_plain(cut(pairs.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()))
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    known = small_or_plain(sketched.select("key", "item", F.col("text").alias("item_text")), ITEM_ROWS)
    rows = texts.unionByName(pairs.join(known, "key"), allowMissingColumns=True).withColumn("group", F.xxhash64("id", "th"))
    order = ["group", "th", "id", F.col("key").asc_nulls_first()]
    names = [id_col, item_id, "n_shingles", "n_found", "containment"]
    return rows.select("id", "th", "text", "key", "item", "item_text", "group").repartition("group").sortWithinPartitions(*order).mapInArrow(_verified(width, t, names), schema)
