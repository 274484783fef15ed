"""The objects of JSON arrays, each array read by many tasks.

A file is split at byte ranges, in pieces that end before a brace. Where a range begins, a brace may stand in a string or
at any depth, which depends on all that came before. So each range is summed up for either case (inside a string, or
not): whether its quotes change that, and which brackets it leaves closed and open. A fold over the ranges of a file, one
short text each, tells each of them where it begins, and a second read takes the objects out. An object that reaches
over the end of its range comes in parts, which are put together; nothing else is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.lineage import BROADCAST_ROWS, cut, packed, tidy

_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\Z)', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("|\Z)|[\[\]{}]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]++|\\.)*+("|\Z)', re.DOTALL)
#: An arrival is made of the number of its file, and of the place in it.
_PLACES, _FILES = 1 << 40, 1 << 18
_RANGE = ["file", "start"]


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value: what stands from one brace to the next, the brace left out, in the order of the file."""
    return spark.read.text(paths, lineSep="{").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, str]]:
    """Rows of one range at a time, whether they are its first, and their text. The columns after the value name the range."""
    last = None
    for batch in batches:
        names = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True))
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            part = batch.slice(at, end - at)
            first = names[at] != last
            text = "{".join(part.column("value").to_pylist())
            yield part, first, text if first and names[at][1] == 0 else "{" + text
            last, at = names[at], end


def brackets(text: str, inside: bool) -> str:
    """The brackets outside strings that have no partner in the text: closing ones, then opening ones."""
    found = re.sub(r"[^\[\]{}]+", "", _STRING.sub("", f'"{text}' if inside else text))
    return _reduced(found)


def _reduced(found: str) -> str:
    while len(less := found.replace("[]", "").replace("{}", "")) < len(found):
        found = less
    return found


def _flips(text: str) -> bool:
    return text.replace("\\\\", "").replace('\\"', "").count('"') % 2 == 1


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for part, first, text in _ranges(batches):
        if first:
            if now is not None:
                yield _summary(*now)
            now = (part.column("file")[0].as_py(), part.column("start")[0].as_py(), False, "", "")
        file, start, flipped, outside, within = now
        now = (file, start, flipped ^ _flips(text), _reduced(outside + brackets(text, flipped)), _reduced(within + brackets(text, not flipped)))
    if now is not None:
        yield _summary(*now)


def _summary(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("file", "start", "flips", "outside", "within"), values, strict=True))])


def _in_object(stack: str) -> bool:
    """Whether this is inside an object of an array that is the whole of the file."""
    return stack.startswith("[{")


def _folded(ranges: pd.DataFrame) -> pd.DataFrame:
    """Where each range of a file begins: inside a string, below which brackets, and in the object that was opened in which range."""
    inside, stack, opened, out = False, "", -1, []
    for r in ranges.sort_values("start").itertuples():
        out.append((r.file, r.start, inside, stack, opened))
        word = r.within if inside else r.outside
        closed = len(word) - len(word.lstrip("]}"))
        kept = stack[: len(stack) - closed]
        if closed > len(stack) or any(a + b not in ("[]", "{}") for a, b in zip(reversed(stack), word[:closed])) or word[closed:].strip("[{"):
            raise ValueError(f"{r.file} is no JSON: brackets do not match")
        stack = kept + word[closed:]
        opened = -1 if not _in_object(stack) else opened if len(kept) >= 2 else r.start
        inside ^= r.flips
    if inside or stack:
        raise ValueError(f"{ranges['file'].iloc[0]} is no JSON: it ends within a text or an array")
    return pd.DataFrame(out, columns=["file", "start", "inside", "stack", "opened"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of each range. place: where an object begins; opened: of a part, the range in which its object begins."""
    held: list[str] = []
    inside, stack, opened, started, key = False, "", -1, 0, None
    for part, first, text in _ranges(batches):
        rows = []
        if first:
            if held:
                yield _objects([_part(key, opened, started, held)])
            key = tuple(part.column(c)[0].as_py() for c in _RANGE)
            inside, stack, opened = (part.column(c)[0].as_py() for c in ("inside", "stack", "opened"))
            held, started = [], 0
        at, open_ = 0, _in_object(stack)
        if inside:
            rest = _REST.match(text)
            inside, at = not rest[1], rest.end()
        begun = 0
        for token in _TOKEN.finditer(text, at):
            c = text[token.start()]
            if c == '"':
                inside = not token[1]
            elif c in "[{":
                stack += c
                if stack == "[{":
                    open_, begun, opened = True, token.start(), key[1]
                    started += 1
            else:
                stack = stack[:-1]
                if open_ and len(stack) == 1:
                    held.append(text[begun : token.end()])
                    rows.append((*key, key[1] + started - 1, -1, "".join(held)) if opened == key[1] else _part(key, opened, started, held))
                    held, open_, opened = [], False, -1
        if open_:
            held.append(text[begun:])
        if rows:
            yield _objects(rows)
    if held:
        yield _objects([_part(key, opened, started, held)])


def _part(key: tuple, opened: int, started: int, held: list[str]) -> tuple:
    """A part of an object; it has the place of the object if that begins in this range."""
    return (*key, key[1] + started - 1 if opened == key[1] else None, opened, "".join(held))


def _objects(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "place", "opened", "value"])


def read_json_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, arrival: the objects in JSON arrays as text, and numbers in the order of files (by name) and places.

    Whatever else an array holds, and files that hold something other than an array, give no rows; a file whose brackets or quotes do
    not match is a ValueError. The files are read twice, in ranges of spark.sql.files.maxPartitionBytes.
    """
    summed = cut(_pieces(spark, paths).mapInArrow(_summed, "file string, start long, flips boolean, outside string, within string"))
    begins = cut(summed.groupBy("file").applyInPandas(_folded, "file string, start long, inside boolean, stack string, opened long"))
    files = begins.select("file").distinct()
    if files.count() > _FILES:
        raise ValueError(f"more than {_FILES} files")
    numbered = files.withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
    rows = _pieces(spark, paths)
    if begins.count() <= BROADCAST_ROWS:  # the rows stay in the order of the file
        told = rows.join(F.broadcast(begins), _RANGE)
    else:
        told = rows.withColumn("i", F.monotonically_increasing_id()).join(begins, _RANGE).repartition(*_RANGE).sortWithinPartitions(*_RANGE, "i")
    found = packed(told.select("value", "file", "start", "inside", "stack", "opened").mapInArrow(_taken, "file string, start long, place long, opened long, value string"))
    parts = found.filter("opened >= 0").groupBy("file", "opened").agg(F.max("place").alias("place"), F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = parts.select("file", "place", F.array_join(F.col("parts.value"), "").alias("value"))
    every = found.filter("opened < 0").select("file", "place", "value").unionByName(joined)
    return every.join(F.broadcast(numbered), "file").select("value", (F.col("number").cast("long") * _PLACES + F.col("place")).alias("arrival"))


def write_json_arrays(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Write JSON texts as a folder of files that each hold an array. rows: value; nulls are left out. Compressed files are read whole, a task each."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for batch in batches:
            values = waiting + batch.column(0).to_pylist()
            waiting = values[-1:]
            yield pa.RecordBatch.from_pydict({"value": pa.array([v + "," for v in values[:-1]], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [*waiting, "]"]})

    with tidy(rows.sparkSession):
        rows.select("value").filter("value is not null").mapInArrow(lines, "value string").write.text(path, compression=compression)
