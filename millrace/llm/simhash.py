"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ, compared by bit planes.

Fingerprints within the radius agree on at least two of five bands, so equal pairs of bands make the groups to compare;
a group that is too large is split by bands of the other bits, of which two agree again.
A group stores its fingerprints as 64 bit planes, a lane for each fingerprint. Against one fingerprint, every plane
gives a word of differing lanes, which carry-save counters add up for all lanes at once; a lane that overflows is out
of the radius, and once all of a block's lanes are out the block is abandoned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import drop
from millrace.llm.common import SMALL_BATCH_BYTES, cut, join_counted, small_or_plain, sorted_groups, starts, text_batches
from millrace.llm.components import components

_SPACE = re.compile(rb"[\x09-\x0D ]")
_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: The bands that the 64 bits fall into; within radius 3, two of the five agree.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints of one block; groups above this are dealt out as pairs of blocks.
BLOCK = 1024
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_pieces(data: bytes, carry: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of a bounded length of text; each begins with the last ``carry`` words (or all) of the one before."""
    at, tail = 0, []
    while at < len(data):
        found = _SPACE.search(data, at + size)
        end = found.start() if found else len(data)
        words = tail + data[at:end].split()
        yield words
        tail, at = words[max(0, len(words) - carry) :] if carry else [], end


def shingle_hashes(data: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, joined by one space; of the whole sequence if it is shorter."""
    found = []
    for words in word_pieces(data, width - 1):
        if len(words) >= width:
            joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64))
    if not found:
        words = data.split()
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)]
    return np.concatenate(found)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array, the bits that are set in over half of its hashes; zero for an empty one."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    base = np.repeat(np.arange(len(sizes)) * 256, sizes)
    lanes = flat.view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(sizes), np.uint64)
    for k in range(8):
        held = np.bincount(base + lanes[:, k], minlength=256 * len(sizes)).reshape(-1, 256) @ _BITS_OF_BYTE
        most = (2 * held > sizes[:, None]).astype(np.uint64)
        out |= (most << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id, fp (long) of each row: A-Z lower-cased, words split at ASCII white space. A null text has no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, n = [], [], 0
            for value in batch.column(1):
                held.append(shingle_hashes((value.as_py() or "").encode("utf-8", "surrogatepass").lower(), width, seed))
                n += len(held[-1])
                if n > 200_000:
                    done.append(majority_bits(held))
                    held, n = [], 0
            done.append(majority_bits(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(scan, f"id {dict(docs.dtypes)[id_col]}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def band_masks(agree: int = 2) -> list[int]:
    """For each choice of bands that agree, the mask of their bits."""
    edges = np.concatenate([[0], np.cumsum(BANDS)])
    bits = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(bits[i] for i in chosen) for chosen in combinations(range(len(BANDS)), agree)]


def finer_masks(mask: int, agree: int = 2) -> list[int]:
    """The mask with the bits of two of five bands of those it lacks, for each choice of two."""
    left = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(left, len(BANDS))]
    return [mask | sum(chosen) for chosen in combinations(parts, agree)]


def _within(planes: np.ndarray, words: np.ndarray | None, fps: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within the radius of each fingerprint. planes: 64 x words; words: the one of each row, or None: all of them.

    The counters have as many bits as the radius; a carry out of the last one marks a lane as out for good.
    """
    levels = radius.bit_length()
    if radius != (1 << levels) - 1:
        raise ValueError("the radius must be one less than a power of two")
    shape = fps.shape if words is not None else (len(fps), planes.shape[1])
    near = np.zeros(shape, np.uint64)
    rows, sums, out = np.arange(len(fps)), [np.zeros(shape, np.uint64) for _ in range(levels)], np.zeros(shape, np.uint64)
    for b in range(64):
        flip = (np.uint64(0) - ((fps[rows] >> np.uint64(b)) & np.uint64(1)))
        carry = planes[b][words[rows]] ^ flip if words is not None else planes[b][None, :] ^ flip[:, None]
        for s in sums:
            s ^= carry
            carry &= ~s
        out |= carry
        if b % 8 == 7:
            alive = ((out & valid[rows] if words is not None else out & valid) != (valid[rows] if words is not None else valid))
            alive = alive if alive.ndim == 1 else alive.any(axis=1)
            if not alive.all():
                rows, sums, out = rows[alive], [s[alive] for s in sums], out[alive]
    near[rows] = ~out & (valid[rows] if words is not None else valid)
    return near


def _closed(near: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Lanes that each row reaches inside its word; first: the row that holds lane 0 of the row's group."""
    while True:
        more = near.copy()
        for lane in range(64):
            hit = np.flatnonzero((near >> np.uint64(lane)) & np.uint64(1))
            if len(hit):
                more[hit] |= near[first[hit] + lane]
        if np.array_equal(more, near):
            return near
        near = more


def _small_links(fps: np.ndarray, begin: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius, for groups of up to 64 that stand one after the other."""
    group = np.repeat(np.arange(len(begin)), size)
    first = np.repeat(begin, size)
    lane = (np.arange(len(fps)) - first).astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lane, begin) for b in range(64)])
    valid = (_ONES >> (np.uint64(64) - size.astype(np.uint64)))[group]
    near = _within(planes, group, fps, valid, radius)
    if not (near != np.uint64(1) << lane).any():
        return fps[:0], fps[:0]
    near = _closed(near, first)
    lowest = np.bitwise_count((near & (~near + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    linked = lowest != lane.astype(np.int64)
    return fps[linked], fps[(first + lowest)[linked]]


def _large_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one group of more than 64."""
    n, full = len(fps), -(-len(fps) // 64)
    padded = np.concatenate([fps, np.zeros(full * 64 - n, np.uint64)]).reshape(full, 64)
    lanes = np.arange(64, dtype=np.uint64)
    planes = np.stack([np.bitwise_or.reduce(((padded >> np.uint64(b)) & np.uint64(1)) << lanes, axis=1) for b in range(64)])
    valid = np.full(full, _ONES)
    if n % 64:
        valid[-1] = _ONES >> np.uint64(64 - n % 64)
    near = np.concatenate([_within(planes, None, fps[i : i + 512], valid, radius) for i in range(0, n, 512)])
    bits = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    root, todo = np.arange(n), np.bitwise_count(near).sum(axis=1) > 1
    for seed in range(n):
        if not todo[seed]:
            continue
        reached, front = near[seed].copy(), bits(near[seed])
        while len(front):
            grown = reached | np.bitwise_or.reduce(near[front], axis=0)
            front, reached = bits(grown & ~reached), grown
        members = bits(reached)
        root[members], todo[members] = seed, False
    linked = root != np.arange(n)
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect what is connected by at most ``radius`` differing bits; not all pairs. distinct: fp.

    Groups of more than ``block`` are split by further bands; what is still as large, as so much of it is alike, is
    dealt out as pairs of blocks.
    """
    masks = band_masks()
    under = lambda t, mask: F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
    keyed = distinct.select("fp", F.inline(F.array(*[under(i, m) for i, m in enumerate(masks)])))
    crowded = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).drop("n"))
    if not crowded.isEmpty():
        crowded = small_or_plain(crowded)
        finer = F.array(*[F.array(*[under(len(masks) * (i + 1) + j, m) for j, m in enumerate(finer_masks(mask))]) for i, mask in enumerate(masks)])
        split = keyed.join(crowded, ["t", "key"], "left_semi").select("fp", F.inline(finer[F.col("t")]))
        keyed = keyed.join(crowded, ["t", "key"], "left_anti").unionByName(split)
    heavy = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "fp"), parts).cast("int")
    others = F.when(parts == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), parts - 1), own))
    dealt = (
        keyed.join(small_or_plain(heavy), ["t", "key"], "left")
        .select("fp", "t", "key", own.alias("own"), F.explode(others).alias("other"))
        .select("fp", "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    keys = ["t", "key", "p", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, keys):
            begin = starts([rows.column(k).to_numpy() for k in keys])
            size = np.diff(np.append(begin, rows.num_rows))
            fps = rows.column("fp").to_numpy().view(np.uint64)
            few = (size > 1) & (size <= 64)
            found = []
            if few.any():
                inside = np.repeat(few, size)
                found.append(_small_links(fps[inside], np.concatenate([[0], np.cumsum(size[few])[:-1]]), size[few], radius))
            for at in np.flatnonzero(size > 64):
                found.append(_large_links(fps[begin[at] : begin[at] + size[at]], radius))
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, radius: int = 3
) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable over links, its own included) of each row.

    Equal fingerprints are compared once, so a large group of copies is one row of the comparison. Null or blank texts
    have fingerprint zero and are linked like any other. Repeated rows each give a row; a null id is never the
    smallest, and a component of nothing else has a null component_id. An empty table gives an empty result.
    """
    text_batches(docs)
    marked = cut(fingerprints(docs, id_col, text, width, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("times")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    linked = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").drop("root")
    named = distinct.join(linked, "fp", "left").select("fp", "times", F.coalesce("component_id", "least").alias("component_id"))
    return join_counted(marked, named, "fp", "times", marked.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of sets of at least SURE shingles with a Jaccard similarity of 0.8 differ by some 10 of 64 bits; beyond FAR
#: lies less than one pair in 100,000 of them, so only pairs within it are verified. Smaller sets are all verified.
FAR, SURE = 24, 32
#: Sets that share one of their least shingles, above which the shingle is put last; and how many are, at most, the most frequent. It costs time only if some are not.
FREQUENT, MOST_FREQUENT = 64, 1_000_000
#: Sets in a group above which sketches, or sets of up to EXACT shingles, are compared in it, before a pair leaves it.
LARGE, EXACT = 64, 512
#: Candidates that a task holds before it gives them on.
PAIRS = 1 << 17
#: Neighbours in a group that are compared before all others.
NEIGHBOURS = 16
#: Bins of a sketch, and by how many deviations a pair's estimate may be too low; fewer than one pair in 100,000 has more.
BINS, DEVIATIONS = 512, 4.5
#: So many times the least shingles that are needed are kept, in case some of them are frequent; texts with more of those are shingled again.
SPARE = 1.25


def shingle_set(value: str | None, width: int, seed: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(shingle_hashes((value or "").encode("utf-8", "surrogatepass").lower(), width, seed))


def bin_sketch(held: np.ndarray) -> bytes:
    """For each of BINS equal ranges of hashes 8 bits of the least one in it, zero where there is none. held: in order."""
    bins = (held >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(held) else np.zeros(0, np.int64)
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = held[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches, a row each, let their sets (of n and m elements) be similar.

    The bins that either has draw so many elements of both sets, without putting any back; so the more of all they are the less they deviate.
    """
    both, same = ((x != 0) | (y != 0)).sum(axis=1), ((x == y) & (x != 0)).sum(axis=1)
    every = (n + m) / (1 + similarity)
    left = np.maximum(every - both, 0) / np.maximum(every - 1, 1)
    return same + 1 >= similarity * both - DEVIATIONS * np.sqrt(similarity * (1 - similarity) * np.maximum(both, 1) * left)


def _plausible(similarity: float):
    """Pairs (a, b) whose sketches (x, y) and sizes (n, m) let them be similar."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(_alike(x, y, batch.column("n").to_numpy(), batch.column("m").to_numpy(), similarity)))

    return scan


def _lists(held: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h.view(kind) for h in held] or [np.zeros(0, kind)])))


def needed(n: int, similarity: float) -> int:
    """Of two sets of which a share of at least ``similarity`` of all elements is common, so many of each, the first in any order that is the same for both, have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _sketched(width: int, seed: int, similarity: float):
    """id, th, digest and size of the shingle set, its fingerprint, its sketch, and SPARE times the least shingles that are needed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps, sketches, least = [], [], [], [], []
            for value in batch.column(2):
                held = shingle_set(value.as_py(), width, seed)
                digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).digest())
                sizes.append(len(held))
                fps.append(majority_bits([held])[0])
                sketches.append(bin_sketch(held))
                least.append(held[: math.ceil(SPARE * needed(len(held), similarity))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), _lists(least)],
                ["id", "th", "digest", "n", "fp", "sketch", "least"],
            )

    return scan


def frequent_last(held: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """held (in order) with what is in often (in order) put last, and how many are not in it."""
    at = np.minimum(np.searchsorted(often, held), len(often) - 1) if len(often) else np.zeros(len(held), int)
    last = often[at] == held if len(often) else np.zeros(len(held), bool)
    return np.concatenate([held[~last], held[last]]), int((~last).sum())


def _reordered(similarity: float, shared):
    """node, n, fp and the least shingles of each set in the order that has the frequent ones last; null where those kept do not tell. rows: node, n, fp, least."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for n, values in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                held, rare = frequent_last(values.values.to_numpy().view(np.uint64), shared.value)
                k = needed(n, similarity)
                least.append(held[:k] if rare >= k or len(held) == n else None)
            known = pa.array([h is not None for h in least])
            lists = pc.if_else(known, _lists([np.zeros(0, np.uint64) if h is None else h for h in least]), pa.nulls(len(least), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["node", "n", "fp", "least"])

    return scan


def _again(width: int, seed: int, similarity: float, shared):
    """The same from the texts. rows: node, n, fp, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(v.as_py(), width, seed) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists([frequent_last(h, shared.value)[0][: needed(len(h), similarity)] for h in sets])], ["node", "n", "fp", "least"])

    return scan


def carried_bits(value: str | None, width: int, seed: int) -> np.ndarray:
    """What the rows of a large group carry of a text's shingles: the last 32 bits of each hash. Sets have no fewer of them in common than of the hashes."""
    return (shingle_set(value, width, seed) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _shared(mark: np.ndarray, ids: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many ids of each of the rows (rising) are marked. edges: where the ids of each row begin, and the end; no row is empty."""
    low, high = rows[0], rows[-1] + 1
    if 3 * len(rows) > high - low:
        return np.add.reduceat(mark[ids[edges[low] : edges[high]]], edges[low:high] - edges[low], dtype=np.int64)[rows - low]
    size = edges[rows + 1] - edges[rows]
    begin = np.cumsum(size) - size
    return np.add.reduceat(mark[ids[np.repeat(edges[rows] - begin, size) + np.arange(size.sum())]], begin, dtype=np.int64)


def _joining(root: np.ndarray, n: np.ndarray, fp: np.ndarray, values: np.ndarray, similarity: float, unite: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different roots whose values, n of each row, are similar; with ``unite`` only those that join what no pair before them has joined. Rows: sorted by n."""
    ids, label = np.unique(values, return_inverse=True)[1], np.unique(root, return_inverse=True)[1]
    edges, least = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), similarity * n - 1e-9
    mark, bits, found = np.zeros(len(ids), bool), fp.view(np.uint64), []
    for i in range(len(n)):
        j = i + 1 + np.flatnonzero(label[i + 1 : np.searchsorted(least, n[i], "right")] != label[i])
        if n[i] >= SURE:
            j = j[np.bitwise_count(bits[i] ^ bits[j]) <= FAR]
        if not len(j):
            continue
        own = ids[edges[i] : edges[i + 1]]
        mark[own] = True
        common = _shared(mark, ids, edges, j)
        mark[own] = False
        j = j[common >= similarity * (n[i] + n[j] - common) - 1e-9]
        if unite:
            j = j[np.unique(label[j], return_index=True)[1]]
            label[np.isin(label, label[j])] = label[i]
        found.append(np.stack([np.full(len(j), i), j]))
    return tuple(np.concatenate([np.zeros((2, 0), int), *found], axis=1))


def _candidates(keys: list[str], similarity: float, steps: int | None = None, unite: bool = True):
    """Pairs of nodes of different roots that share a key, whose sizes, fingerprints and sketches (where there are any) let them be similar; of up to so many steps between them.

    Rows that carry their shingles are compared by these, at any distance: with ``unite`` what is given on for a group joins its similar sets, without, each similar pair is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, keys):
            begin = starts([rows.column(k).to_numpy() for k in keys])
            end = np.repeat(np.append(begin[1:], rows.num_rows), np.diff(np.append(begin, rows.num_rows)))
            node, root, n, fp = (rows.column(k).to_numpy() for k in ("node", "root", "n", "fp"))
            held = rows.column("sketch")
            has = np.asarray(held.is_valid())
            sketch = np.frombuffer(b"".join(held.drop_null().to_pylist()), np.uint8).reshape(-1, BINS)
            place = np.cumsum(has) - 1
            at, step, found, held_pairs = np.arange(rows.num_rows), 1, [], 0
            carried = rows.column("shingles").combine_chunks()
            exact = np.asarray(carried.is_valid())
            for low in begin[exact[begin]]:
                high = low + int(exact[low : end[low]].sum())  # the smaller sets come first
                x, y = _joining(root[low:high], n[low:high], fp[low:high], carried[low:high].flatten().to_numpy(), similarity, unite)
                if len(x):
                    x, y = node[low + x], node[low + y]
                    yield _once([np.stack([np.minimum(x, y), np.maximum(x, y)])], True)
            at = at[~exact[end - 1]]
            while (steps is None or step <= steps) and len(at := at[at + step < end[at]]):
                few, many = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
                near = (root[at] != root[at + step]) & ~exact[at + step] & (few >= similarity * many - 1e-9) & ((few < SURE) | (np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + step].view(np.uint64)) <= FAR))
                first = at[near]
                alike = np.ones(len(first), bool)
                shown = np.flatnonzero(has[first])
                for part in np.array_split(shown, max(1, len(shown) // 4096)):
                    own = first[part]
                    alike[part] = _alike(sketch[place[own]], sketch[place[own + step]], n[own], n[own + step], similarity)
                first = first[alike]
                if len(first):
                    x, y = node[first], node[first + step]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    held_pairs += len(first)
                if held_pairs > PAIRS:
                    yield _once(found, False)
                    found, held_pairs = [], 0
                step += 1
            if found:
                yield _once(found, False)

    return scan


def _once(found: list[np.ndarray], joins: bool) -> pa.RecordBatch:
    """Each of the pairs (a, b) once; joins: whether they stand for others of their group."""
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(pairs.shape[1], joins))], ["a", "b", "joins"])


def _linked_nodes(nodes: DataFrame, radius: int, block: int) -> DataFrame:
    """Pairs (a, b) of nodes that join those whose fingerprints are connected by at most ``radius`` differing bits; not all pairs. nodes: node, fp."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("times")))
    equal = join_counted(nodes, first, "fp", "times", nodes.count()).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = links(first.select("fp"), radius, block)
    for end in ("a", "b"):
        ends = ends.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"n{end}")), end)
    return equal.unionByName(ends.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, similarity: float = 0.8, block: int = BLOCK, radius: int = 3
) -> DataFrame:
    """id, component_id, text_hash and group of each row: texts are linked whose sets of ``width``-word shingles have a Jaccard
    similarity of at least that. group is a number that only the rows of one component share. Other columns are neither read nor returned, and an empty table gives an empty result.

    First come the texts whose fingerprints links() joins, which differ by up to ``radius`` bits. Similar texts may differ by more (by
    some 10 bits), so for those that are not joined yet, texts that share one of their least shingles are candidates as well; fingerprints and
    sketches thin them out. In a large group the rows carry their shingles (of sets of up to EXACT), so that of all its pairs only those leave it
    that join similar texts. The shingles themselves decide on all candidates. Equal sets are compared once; what links or neighbours of a group have joined is not compared again. Null and blank texts are copies of each other, a null id is never the smallest, as in near_duplicates.
    """
    text_batches(docs, SMALL_BATCH_BYTES)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(v.as_py(), width, seed) for v in batch.column(1)])], ["th", "shingles"])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([carried_bits(v.as_py(), width, seed) for v in batch.column(1)], np.int32)], ["th", "shingles"])

    kinds = f"id {dict(docs.dtypes)[id_col]}, th long, digest binary, n int, fp long, sketch binary, least array<long>"
    sketched = cut(base.mapInArrow(_sketched(width, seed, similarity), kinds))
    one = sketched.groupBy("digest").agg(F.min("id").alias("smallest"), F.count("*").alias("times"), F.min(F.struct("th", "n", "fp", "sketch", "least")).alias("x"))
    distinct = cut(one.select("digest", "smallest", "times", "x.*").withColumn("node", F.monotonically_increasing_id()))
    marked = cut(sketched.select("id", "th", "digest"))
    drop(sketched)
    # passages that many texts share would make large groups, so their shingles come last
    first_of = F.slice("least", 1, F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1)
    met = distinct.select(F.explode(first_of).alias("s")).groupBy("s").agg(F.count("*").alias("m"))
    often = met.filter(F.col("m") > FREQUENT).orderBy(F.desc("m"), "s").limit(MOST_FREQUENT).select("s").toArrow()["s"].to_numpy().view(np.uint64)
    ordered = docs.sparkSession.sparkContext.broadcast(np.sort(often))  # MOST_FREQUENT at most
    listed = "node long, n int, fp long, least array<long>"
    told = cut(distinct.select("node", "n", "fp", "least").mapInArrow(_reordered(similarity, ordered), listed))
    untold = cut(told.filter("least is null").drop("least").join(distinct.select("node", "th"), "node"))
    texts = base.select("th", "text").join(small_or_plain(untold.select("th")), "th", "left_semi").dropDuplicates(["th"])
    again = cut(texts.join(untold, "th").select("node", "n", "fp", "text").mapInArrow(_again(width, seed, similarity, ordered), listed))
    keyed = told.filter("least is not null").unionByName(again).select("node", "n", "fp", F.explode("least").alias("s"))
    shared = cut(keyed.groupBy("s").agg(F.count("*").alias("m")).filter("m > 1"))
    parts = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), parts).cast("int")
    others = F.when(parts == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), parts - 1), own))
    large = keyed.join(shared.filter(F.col("m") > LARGE), "s").join(distinct.select("node", "sketch"), "node")
    small = keyed.join(shared.filter(F.col("m") <= LARGE), "s").withColumn("sketch", F.lit(None).cast("binary"))
    dealt = small.unionByName(large).select("s", "node", "n", "fp", "sketch", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("s", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "n", "fp", "sketch")
    keys = ["s", "p", "q"]
    dealt = cut(dealt)

    def verified(found: DataFrame) -> DataFrame:
        left, right = (distinct.select(F.col("node").alias(end), F.col("sketch").alias(name), F.col("n").alias(size)) for end, name, size in (("a", "x", "n"), ("b", "y", "m")))
        met = found.distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")
        pairs = cut(met.mapInArrow(_plausible(similarity), "a long, b long"))
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "th"), "node"))
        texts = base.select("th", "text").join(small_or_plain(wanted.select("th").distinct()), "th", "left_semi").dropDuplicates(["th"])
        known = cut(texts.mapInArrow(sets, "th long, shingles array<long>").join(wanted, "th").select("node", "shingles"))
        both = pairs.join(known.toDF("a", "left"), "a").join(known.toDF("b", "right"), "b")
        both = both.select("a", "b", F.size("left").alias("x"), F.size("right").alias("y"), F.size(F.array_intersect("left", "right")).alias("common"))
        return cut(both.filter(F.col("common") >= similarity * (F.col("x") + F.col("y") - F.col("common")) - 1e-9).select("a", "b"))

    def candidates(rows: DataFrame, joined: DataFrame, steps: int | None = None, unite: bool = True) -> DataFrame:
        rows = rows.join(small_or_plain(cut(components(joined))), "node", "left").withColumn("root", F.coalesce("root", "node"))
        return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "fp").mapInArrow(_candidates(keys, similarity, steps, unite), "a long, b long, joins boolean")

    near = verified(_linked_nodes(distinct.select("node", "fp"), radius, block))
    plain = dealt.withColumn("shingles", F.lit(None).cast("array<int>"))
    joined = near.unionByName(verified(candidates(plain, near, NEIGHBOURS).drop("joins")))
    # the sets of large groups go with their rows from here on, a sketch only where it may meet a larger set
    exact = F.col("sketch").isNotNull() & (F.col("n") <= EXACT)
    wanted = cut(dealt.filter(exact).select("node").distinct().join(distinct.select("node", "th"), "node"))
    texts = base.select("th", "text").join(small_or_plain(wanted.select("th")), "th", "left_semi").dropDuplicates(["th"])
    known = cut(texts.mapInArrow(carried, "th long, shingles array<int>").join(wanted, "th").select("node", "shingles"))
    bare = dealt.filter(exact).withColumn("sketch", F.when(F.col("n") >= similarity * EXACT - 1, F.col("sketch")))
    rows = bare.join(known, "node").unionByName(plain.filter(~exact | F.col("sketch").isNull()))
    found = cut(candidates(rows, joined))
    rest = verified(found.drop("joins"))
    joined = joined.unionByName(rest)
    # a pair that was similar only by chance may stand for others in its group
    if not found.filter("joins").join(rest, ["a", "b"], "left_anti").isEmpty():
        joined = joined.unionByName(verified(candidates(rows, joined, unite=False).drop("joins")))
    roots = components(joined)
    rooted = roots.join(distinct.select("node", "smallest"), "node")
    linked = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "root")
    named = distinct.join(linked.select("node", "root", "component_id"), "node", "left").select(
        "digest", "times", F.coalesce("root", "node").alias("group"), F.when(F.col("root").isNull(), F.col("smallest")).otherwise(F.col("component_id")).alias("component_id")
    )
    found = join_counted(marked, named, "digest", "times", marked.count())
    return found.select(F.col("id").alias(id_col), "component_id", F.col("th").alias("text_hash"), "group")
