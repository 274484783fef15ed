from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pytest

from millrace.llm import warc

LONG = "x" * 99 + "é"  # 101 bytes


def pages(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame([(*r, "a", 1) for r in rows], f"{schema}, digest string, payload int").repartition(3)


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            body = (html or "").encode()
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = first.get(body) if len(body) >= 100 else None
        revisit = to is not None and to != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/ b", LONG), (2, None, LONG), (9, "http://a/\r\nWARC-Type: evil", LONG), (2, "u", LONG), (None, "u", LONG), (None, "u", "alone" * 30),
    (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (8, "u", "y" * 3_000_000), (10, "u", "y" * 3_000_000), (11, "ü", "\x00퟿ " * 50),
]


@pytest.mark.parametrize("most", [100, 0])
def test_what_is_written_is_read_back(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    archives = warc.write(pages(spark, ROWS), warc.new_folder(spark), archive_bytes=500)
    assert archives.count() > 3
    index = warc.normalise(archives)
    found = warc.read(index, chunk_bytes=100).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found), key=str) == expected(ROWS)
    assert all(r["intact"] for r in found)
    assert {r["url"] for r in found if r["page_id"] == 5} == {"http://a/%20b"} and {r["url"] for r in found if r["page_id"] == 11} == {"ü"}
    by_id = {r["page_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert bytes(by_id[7]) == ROWS[10][2].encode() and bytes(by_id[8]) == b"y" * 3_000_000


def test_archives_and_members_as_files(spark):
    archives = warc.write(pages(spark, ROWS[:8]), warc.new_folder(spark))
    index = warc.normalise(archives)
    for row in archives.collect():
        data = open(row["archive"].removeprefix("file:"), "rb").read()
        whole = zlib.decompressobj(wbits=31)
        whole.decompress(data)
        assert whole.eof and not whole.unused_data  # a single stream
    by_archive = {}
    for row in index.collect():
        by_archive.setdefault(row["archive"], []).append(row)
    for name, rows in by_archive.items():
        data = open(name.removeprefix("file:"), "rb").read()
        assert sum(r["length"] for r in rows) == len(data)
        for r in rows:
            member = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and r["id"].encode() in member
        assert sum(r["type"] == "warcinfo" for r in rows) == 1


def test_files_of_lost_tasks_are_not_read(spark):
    folder = warc.new_folder(spark)
    archives = warc.write(pages(spark, ROWS[:4]), folder)
    warc.write(pages(spark, ROWS[4:8]), folder)  # what another attempt left behind
    index = warc.normalise(archives)
    warc.normalise(archives)
    assert sorted(r["page_id"] for r in warc.read(index).collect()) == [2, 2, 5, 9]


def test_records_of_any_members_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    made = [warc.record(i, "u", b"z" * (i * 40), "d", None, "t") for i in range(5)]
    for data in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made)), gzip.compress(made[0] + made[1][:50]) + gzip.compress(made[1][50:] + b"".join(made[2:]))):
        assert [r for _, r in warc.records(io.BytesIO(data))] == made
    for broken in (b"".join(made)[:-60], b"".join(made)[: len(made[0]) + 20]):
        with pytest.raises(ValueError, match="ends within"):
            list(warc.records(io.BytesIO(gzip.compress(broken))))


def test_no_pages_and_ids_that_are_texts(spark):
    none = pages(spark, ROWS).filter("false")
    assert warc.digest(warc.read(warc.normalise(warc.write(none, warc.new_folder(spark))))).collect() == []
    rows = [("b>/ %", "u", LONG), ("ä", "u", LONG), ("", "u", "s"), (None, "u", "s")]
    found = warc.read(warc.normalise(warc.write(pages(spark, rows, "page_id string, url string, html string"), warc.new_folder(spark))), id_type="string")
    assert sorted(map(tuple, warc.digest(found).collect()), key=str) == expected(rows)
