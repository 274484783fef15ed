"""WARC archives: written as whole gzip streams, made into a member for each record with a sidecar of offsets, and read by these.

An archive is written by one task to a folder that all executors share, under a name that no other attempt has. What
counts is the table that the tasks return, which Spark commits once for each: files that a lost task left behind are in
no such table and are never read. The same holds for the archives and sidecars of the normaliser.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import BROADCAST_ROWS, own_dir
from millrace.llm.common import cut, join_counted, small_or_plain, text_batches

#: Payloads of fewer bytes never refer to an earlier one.
LEAST_BYTES = 100
#: An archive is closed when it has so many bytes of records (before gzip); each is inflated by one task.
ARCHIVE_BYTES = 256 << 20
#: Records in so many bytes of an archive are read by one task.
CHUNK_BYTES = 8 << 20
#: Bytes that are read or inflated at a time, and the level of gzip.
PIECE, LEVEL = 1 << 20, 4
_ARCHIVES = "archive string, records long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that driver and executors share."""
    return f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def _name_of(page) -> str:
    return "urn:page" if page is None else f"urn:page:{quote(str(page), safe='')}"


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """The lines of a record's head; what would break a line is escaped, and what is not there is left out."""
    lines = [f"{name}: {re.sub('[\x00-\x20\x7f]+', lambda m: quote(m[0]), value) if name.endswith('URI') else value}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def record(page, url: str | None, payload: bytes, digest: str, first, date: str) -> bytes:
    """A response, or a revisit of the page ``first``, which has the head of the answer alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{_name_of(page)}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", None if first is None else f"<{_name_of(first)}>"),
        ("WARC-Profile", None if first is None else _PROFILE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record for each page to archives of one gzip stream each; (archive, records) of those that count.

    The payload is the html in UTF-8, empty for null. Of the pages with equal payloads of LEAST_BYTES or more, that with the
    smallest id is a response and the others are revisits of it; pages that share the smallest id are all responses, and so are all
    where none has an id. Payloads are equal if their SHA-256 is. A null url leaves its line out, a null id has a
    name of its own. Repeated rows are records of their own; an empty table gives no archive. Other columns are not read.
    """
    text_batches(pages)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_BYTES
    firsts = cut(rows.filter(large).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")))
    shared = firsts.filter("n > 1").select(F.col("digest").alias("same"), "first")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then the payloads are not shuffled
        found = rows.join(F.broadcast(shared), large & (F.col("digest") == F.col("same")), "left").drop("same")
    else:
        found = join_counted(rows.filter(large), firsts, "digest", "n", firsts.agg(F.sum("n")).first()[0])
        found = found.unionByName(rows.filter(~large), allowMissingColumns=True)
    revisit = ~F.col("page").eqNullSafe(F.col("first"))
    found = found.select("page", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for page, address, body, digest, first in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is None:
                    out = _Stream(folder, date)
                out.add(record(page, address, body, digest, first, date))
                if out.bytes >= archive_bytes:
                    yield out.close()
                    out = None
        if out is not None:
            yield out.close()

    return cut(found.mapInArrow(archive, _ARCHIVES))


class _Stream:
    """An archive that is one gzip stream, which begins with a record about itself."""

    def __init__(self, folder: str, date: str) -> None:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.file, self.gzip, self.bytes, self.records, self.folder = files.open_output_stream(f"{path}/{self.name}", compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0, folder
        self.add(_info(self.name, date))

    def add(self, data: bytes) -> None:
        self.file.write(self.gzip.compress(data))
        self.bytes += len(data)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.file.write(self.gzip.flush())
        self.file.close()
        return pa.RecordBatch.from_pydict({"archive": [f"{self.folder}/{self.name}"], "records": [self.records]})


class _Inflated:
    """The bytes of a gzip file of any number of members, a piece at a time."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.gzip, self.held, self.ended = file, zlib.decompressobj(wbits=31), b"", False

    def more(self) -> bool:
        """Whether anything was added to what is held."""
        while not self.ended:
            if self.gzip.eof:
                rest = self.gzip.unused_data or self.file.read(PIECE)
                self.gzip = zlib.decompressobj(wbits=31)
            else:
                rest = self.gzip.unconsumed_tail or self.file.read(PIECE)
            if not rest:
                self.ended = True
                break
            data = self.gzip.decompress(rest, PIECE)
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within the head of a record")
                return None
        return self._cut(end + len(mark))

    def exactly(self, n: int) -> bytes:
        pieces, missing = [], n
        while missing:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            pieces.append(self._cut(min(missing, len(self.held))))
            missing -= len(pieces[-1])
        return b"".join(pieces)

    def _cut(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    """The named lines of a head, with names in lower case."""
    lines = [line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
    return {name.strip().lower(): value.strip() for name, value in lines}


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record of a gzip file: its fields, and all its bytes."""
    data = _Inflated(file)
    while (head := data.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        fields = _fields(head)
        yield fields, head + data.exactly(int(fields["content-length"])) + b"\r\n\r\n"
        data.exactly(4)


_INDEX = "archive string, offset long, length long, type string, id string"


def normalise(archives: DataFrame) -> DataFrame:
    """Inflate each archive once and write every record as a gzip member of its own; the index (archive, offset, length, type, id) of these.

    The new archives lie beside the old ones, each with a sidecar of JSON lines, one for each record: the index is read from those.
    Archives of any number of members are taken; one that ends within a record is an error. No archives give an empty index.
    """
    spark = archives.sparkSession
    names = cut(archives.select("archive"))
    n = names.count()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old in batch.column(0).to_pylist():
                folder = old.rsplit("/", 1)[0]
                new = f"{folder}/{uuid.uuid4().hex}.members.warc.gz"
                files, path = _open(folder)
                side = re.sub(r"\.warc\.gz$", ".index.json", new)
                here = lambda whole, path=path: f"{path}/{whole.rsplit('/', 1)[1]}"
                at = written = 0
                with (
                    files.open_input_stream(here(old), compression=None) as given,
                    files.open_output_stream(here(new), compression=None) as out,
                    files.open_output_stream(here(side), compression=None) as index,
                ):
                    for fields, data in records(given):
                        gzip = zlib.compressobj(LEVEL, wbits=31)
                        member = gzip.compress(data) + gzip.flush()
                        line = {"archive": new, "offset": at, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
                        out.write(member)
                        index.write(json.dumps(line).encode() + b"\n")
                        at, written = at + len(member), written + 1
                yield pa.RecordBatch.from_pydict({"archive": [new], "sidecar": [side], "records": [written]})

    made = cut(names.repartition(max(1, n)).mapInArrow(members, "archive string, sidecar string, records long"))
    folders = [r[0] for r in made.select(F.regexp_replace("sidecar", "/[^/]*$", "")).distinct().limit(1001).collect()]
    if not folders:
        return spark.createDataFrame([], _INDEX)
    if len(folders) > 1000:
        raise ValueError("archives of more than 1000 folders")
    lines = spark.read.schema(_INDEX).json([f"{f}/*.index.json" for f in folders])
    return lines.join(small_or_plain(made.select("archive")), "archive", "left_semi")


def read(index: DataFrame, *, id_type: str = "long", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, intact of each response and revisit that the index names.

    Members are read from their offsets, each alone, by as many tasks as the archives have chunks. The payload of a revisit is
    null and its length and digest are as stated; those of a response are of what was read, and intact says whether the record states the same.
    """
    text_batches(index)
    chunk = F.floor(F.col("offset") / chunk_bytes).alias("chunk")
    listed = index.filter(F.col("type").isin("response", "revisit")).select("archive", chunk, "offset", "length")
    tasks = max(1, -(-(listed.agg(F.sum("length")).first()[0] or 0) // chunk_bytes))  # the index is small, so Spark would put all of it into one
    schema = "page string, url string, record_type string, first string, stated_bytes long, stated string, payload binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, _, offset, length in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if archive != name:
                    folder, last = archive.rsplit("/", 1)
                    files, path = _open(folder)
                    name, file = archive, files.open_input_file(f"{path}/{last}")
                rows.append(_parsed(zlib.decompress(file.read_at(length, offset), wbits=31)))
                size += len(rows[-1][-1] or b"")
                if size > 8 * PIECE:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    found = listed.repartition(tasks, "archive", "chunk").sortWithinPartitions("archive", "offset").mapInArrow(scan, schema)
    digest, whole = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    return found.select(
        F.col("page").cast(id_type).alias("page_id"), "url", "record_type", F.col("first").cast(id_type).alias("refers_to"),
        F.coalesce(whole, "stated_bytes").alias("payload_bytes"), F.coalesce(digest, "stated").alias("payload_digest"), "payload",
        F.coalesce((whole == F.col("stated_bytes")) & (digest == F.col("stated")), F.col("payload").isNull()).alias("intact"),
    )


def _page(name: str | None) -> str | None:
    found = re.match(r"<urn:page:(.*)>$", name or "")
    return unquote(found[1]) if found else None


def _parsed(data: bytes) -> tuple:
    head, block = data.split(b"\r\n\r\n", 1)
    fields = _fields(head)
    http, payload = block[: int(fields["content-length"])].split(b"\r\n\r\n", 1)
    kind = fields["warc-type"]
    return (
        _page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), int(_fields(http)["content-length"]),
        fields["warc-payload-digest"].removeprefix("sha256:"), payload if kind == "response" else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page", "url", "record_type", "first", "stated_bytes", "stated", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digest(found: DataFrame) -> DataFrame:
    """The columns that say what each page's record is."""
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
