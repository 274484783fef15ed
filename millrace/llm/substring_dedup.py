"""Substring dedup: passages of ``window`` words that an earlier document has too, found in prefix-partitioned suffix arrays.

Of each window of words the run of a few words with the least hash is its anchor, and the suffix that begins there is
the one that is indexed; equal windows have equal anchors, and a text has few. Suffixes are partitioned by their
prefix, which is the anchor, and only prefixes that two documents share make a partition. Where too many suffixes share
one for a task, equal stretches of words are found first, of which the smallest document's alone goes on, and these are
partitioned by longer prefixes, until they fit or the prefix is the whole window. In a partition the words that lie
round the suffixes are sorted into a suffix array by doubling; neighbours that agree in as many words as a window are
the leaves of one internal node that deep, a repeat, whose smallest document keeps it. A partition of whole windows is
a single node, and its smallest document a plain minimum that is combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, join_counted, sorted_groups, starts, text_batches
from millrace.llm.windows import chunks

WINDOW_WORDS = 50
#: Words of the prefixes that suffixes are partitioned by, the longer for partitions that are too large; the last is the window.
PREFIXES = (16, 32)
#: Suffixes of a partition up to which they make one tree.
TREE_ROWS = 1000


def _bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _anchors(texts: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the anchors of all texts, in order: the text, and hash, first and last window (numbers of their first words)."""
    span, text, found = window - prefix + 1, [], [[], [], []]
    for c in chunks(texts, window - 1):
        first, h = c.hashes(prefix)
        if len(first) < span:
            continue
        at = np.arange(len(first) - span + 1)
        at = at[c.piece[first[at]] == c.piece[first[at + span - 1]]]
        if not len(at):
            continue
        least = at + np.lib.stride_tricks.sliding_window_view(h, span)[at].argmin(axis=1)
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (c.piece[first[at[1:]]] != c.piece[first[at[:-1]]])]))
        until = np.append(new[1:], len(at)) - 1
        piece = c.piece[first[at[new]]]
        begin = np.searchsorted(c.piece, piece)
        text.append(c.text[piece])
        found[0].append(h[least[new]].view(np.int64))
        for k, w in ((1, new), (2, until)):
            found[k].append((c.number[piece] + first[at[w]] - begin).astype(np.int32))
    if not text:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
    return np.concatenate(text), [np.concatenate(x) for x in found]


def _described(window: int):
    """id, th, n_words, sha of the words, and the anchors of each text."""
    kind = pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_bytes(v) for v in batch.column(2).to_pylist()]
            sizes, shas = [], []
            for t in texts:  # one text's words at a time are held
                words = t.split()
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
            text, columns = _anchors(texts, window, PREFIXES[0])
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), held,
                ],
                ["id", "th", "n_words", "sha", "anchors"],
            )

    return scan


def _segments(window: int):
    """The stretch of words that the windows of each listed anchor cover."""

    kinds = [
        ("h", pa.int64()), ("hot", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("segment", pa.binary()),
    ]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t, value, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _bytes(value).split()
                for a in listed:
                    segment = b" ".join(words[a["lo"] : a["hi"] + window])
                    digest = hashlib.blake2b(segment, digest_size=16).digest() if a["hot"] else None
                    rows.append((a["h"], a["hot"], i, t, a["lo"], a["hi"] + window - a["lo"], digest, segment))
                if len(rows) > 5000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return scan


def _lengthened(window: int, prefix: int):
    """The stretches round the suffixes of each stretch, by prefixes of so many words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column(3).to_pylist()
            text, (h, low, high) = _anchors(segments, window, prefix)
            parts, words, at = [], [], -1
            for t, a, b in zip(text, low, high, strict=True):
                if t != at:
                    at, words = t, segments[t].split(b" ")
                parts.append(b" ".join(words[a : b + window]))
            own = batch.take(pa.array(text))
            lo = pa.array(own.column(2).to_numpy() + low, pa.int32())
            digests = pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), own.column(0), own.column(1), lo, pa.array(high - low + window, pa.int32()), digests, pa.array(parts, pa.binary())],
                ["h", "id", "th", "lo", "n", "digest", "segment"],
            )

    return scan


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a row of words in the order of their first ``depth`` words, and for each in that order whether it
    agrees in all of these with the one before. Suffixes of fewer words stand as if others followed."""
    rank, have = pd.factorize(words, sort=True)[0].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])[: len(rank)]
        rank, have = np.unique(rank * (rank.max(initial=0) + 1) + later, return_inverse=True)[1], have + step
    order = np.argsort(rank, kind="stable")
    return order, np.concatenate([np.zeros(min(1, len(order)), bool), rank[order[1:]] == rank[order[:-1]]])


#: Suffixes that are sorted at once, about; partitions of up to TREE_ROWS are taken together.
_SORTED_ROWS = 2000


def _bounded(tables: Iterator[pa.Table], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, cut between groups into such of not many more than _SORTED_ROWS rows."""
    for rows in tables:
        begin = starts([rows.column(key).to_numpy()])
        cuts = [0]
        for at in begin[1:]:
            if at - cuts[-1] >= _SORTED_ROWS:
                cuts.append(int(at))
        for a, b in zip(cuts, [*cuts[1:], rows.num_rows], strict=True):
            yield rows.slice(a, b - a)


def _trees(window: int):
    """Per partition of suffixes: the stretches of words that a smaller id has too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bounded(sorted_groups(batches, ["h"]), "h"):
            parts = [s.split(b" ") for s in rows.column("segment").to_pylist()]
            size = np.array([len(p) for p in parts])
            order, alike = suffix_array(np.array([w for p in parts for w in p], dtype=object), window)
            row = np.repeat(np.arange(len(parts)), size)
            number = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            node = np.cumsum(~alike) - 1  # of the leaves in order
            whole = (number <= size[row] - window)[order]
            order, node = order[whole], node[whole]
            ids = rows.column("id").to_numpy()[row[order]]
            least = np.full(node.max(initial=0) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, ids)
            gone = np.sort(order[ids > least[node]])
            row, number = row[gone], number[gone]
            if not len(row):
                continue
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)])
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(row)) - 1
            took = rows.take(pa.array(row[at]))
            lo = took.column("lo").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [took.column("id").combine_chunks(), took.column("th").combine_chunks(), pa.array(lo + number[at], pa.int64()), pa.array(lo + number[end] + window, pa.int64())],
                ["id", "th", "from", "until"],
            )

    return scan


def _spelt_out(window: int):
    """Each window of the segments by the digest of its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, lo, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = segment.split(b" ")
                digests = [hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest() for k in range(len(words) - window + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests), pa.array([i] * n), pa.array([t] * n), pa.array(np.arange(lo, lo + n), pa.int64())], ["node", "id", "th", "from"]
                )

    return scan


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas = [], []
        for value, stretches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = _bytes(value).split()
            edge = np.zeros(len(words) + 1, np.int64)
            for s in stretches:
                edge[s["from"]] += 1
                edge[s["until"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(~gone))).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas)], ["id", "th", "n_removed", "sha_left"])


def _shared(suffixes: DataFrame, tree_rows: int) -> DataFrame:
    """h and hot of the prefixes that two ids share, hot where too many suffixes have one. suffixes: h, id."""
    found = suffixes.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    return cut(found.filter("a < b").select("h", (F.col("n") > tree_rows).alias("hot")))


def repeats(docs: DataFrame, described: DataFrame, window: int, tree_rows: int) -> DataFrame:
    """id, th, from, until: stretches of words that windows cover which a smaller id has too. described: of the texts that take part."""
    suffixes = described.select("id", "th", F.inline("anchors"))
    listed = suffixes.join(_shared(suffixes, tree_rows), "h").groupBy("id", "th").agg(F.collect_list(F.struct("h", "hot", "lo", "hi")).alias("listed"))
    segments = docs.join(listed, ["id", "th"]).select("id", "th", "text", "listed").mapInArrow(
        _segments(window), "h long, hot boolean, id long, th long, lo int, n int, digest binary, segment binary"
    )
    segments, out = cut(segments), None
    for prefix in (*[p for p in PREFIXES[1:] if p < window], window):
        cold = segments.filter("not hot").select("h", "id", "th", "lo", "segment").repartition("h").sortWithinPartitions("h")
        found = cold.mapInArrow(_trees(window), "id long, th long, from long, until long")
        out = found if out is None else out.unionByName(found)
        hot = segments.filter("hot")
        if hot.isEmpty():
            return out
        first = cut(hot.groupBy("digest").agg(F.min("id").alias("first")))
        copies = hot.select("digest", "id", "th", "lo", "n").join(first, "digest").filter("id > first")
        out = out.unionByName(copies.select("id", "th", F.col("lo").cast("long").alias("from"), (F.col("lo") + F.col("n")).cast("long").alias("until")))
        own = hot.join(first.withColumnRenamed("first", "id"), ["digest", "id"], "left_semi").select("id", "th", "lo", "segment")
        if prefix < window:
            longer = cut(own.mapInArrow(_lengthened(window, prefix), "h long, id long, th long, lo int, n int, digest binary, segment binary"))
            segments = longer.join(_shared(longer, tree_rows), "h")
    spelt = cut(own.mapInArrow(_spelt_out(window), "node binary, id long, th long, from long"))
    least = cut(spelt.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").drop("last"))
    nodes = spelt.join(least, "node").filter("id > least").select("id", "th", "from", (F.col("from") + window).alias("until"))
    return out.unionByName(nodes)


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of each row: a word goes if a window over it also starts in a row with a smaller id.

    Windows are judged on the input. Whole copies are found by the digest of their words first and leave the search,
    so a large group of copies is one text in it. A null text has no words; texts shorter than the window lose
    nothing. Rows with a null id, and windows that only rows of an equal id share, neither take nor lose anything.
    Repeated rows each give a row, an empty table gives none. Ids are whole numbers.
    """
    text_batches(docs)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    described = cut(
        base.select("id", "th", "text").mapInArrow(
            _described(window), "id long, th long, n_words long, sha binary, anchors array<struct<h:long,lo:int,hi:int>>"
        )
    )
    first = cut(described.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("times")))
    marked = join_counted(described, first, "sha", "times", described.count()).withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    taking_part = marked.filter("not copy and id is not null and size(anchors) > 0").dropDuplicates(["id", "th"])
    texts = base.filter("id is not null")
    stretches = repeats(texts, taking_part, window, tree_rows)
    listed = stretches.groupBy("id", "th").agg(F.collect_list(F.struct("from", "until")).alias("stretches"))
    changed = (
        texts.join(listed, ["id", "th"]).select("id", "th", "text", "stretches")
        .mapInArrow(_kept, "id long, th long, n_removed long, sha_left binary")
        .dropDuplicates(["id", "th"])
    )
    whole_copy = F.col("copy") & (F.col("n_words") >= window)
    return marked.join(changed, ["id", "th"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(whole_copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("sha_left", "sha")))).alias("kept_sha256"),
    )
