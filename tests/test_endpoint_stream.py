from __future__ import annotations

import json

import pytest

from millrace.sources import paged, readers
from millrace.sources.paged import changed_at


def contact(key, changed):
    return {"id": key, "updatedAt": changed, "properties": {"email": f"{key}@x.example", "firstname": key}}


def pages(contacts, size=2):
    out = []
    for at in range(0, len(contacts), size):
        more = {"paging": {"next": {"after": str(at + size)}}} if at + size < len(contacts) else {}
        out.append({"path": readers.CONTACT_PATH, "params": {"after": str(at)} if at else {}, "body": {"results": contacts[at : at + size]} | more})
    return json.dumps(sorted(out, key=lambda e: -len(e["params"])))


def landed(spark, folder, contacts, until):
    """The keys that a start of the stream delivers, by batch."""
    batches = []
    server = {"exchanges": pages(contacts), "waits": "false", "pageSize": "2", "until": until}
    stream = readers.stream_contacts(spark, server).writeStream.foreachBatch(lambda df, i: batches.append((i, sorted(r["natural_key"] for r in df.collect()))))
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return batches


def test_a_restart_reads_on_from_the_cursor(spark, tmp_path):
    day = lambda n: f"2026-01-{n:02d}T00:00:00Z"
    first = [contact("a", day(1)), contact("b", day(3)), contact("c", day(2)), contact("late", day(9))]
    assert landed(spark, tmp_path, first, day(3)) == [(0, ["a", "b", "c"])]
    assert landed(spark, tmp_path, first, day(3)) == []  # nothing twice
    second = [contact("a", day(5)), *first[1:], contact("d", "2026-01-03T00:00:00.000001+00:00"), contact("e", "2026-01-04T01:00:00+02:00")]
    assert landed(spark, tmp_path, second, day(6)) == [(1, ["a", "d", "e"])]
    assert landed(spark, tmp_path, second, day(9)) == [(2, ["late"])]


def test_a_failed_batch_is_read_again_between_the_same_times(spark, tmp_path):
    day = lambda n: f"2026-01-{n:02d}T00:00:00Z"
    rows, seen = [contact("a", day(1)), contact("b", day(2))], []
    server = {"exchanges": pages(rows), "waits": "false", "pageSize": "2"}

    def start(until, fails):
        def take(df, i):
            seen.append((i, sorted(r["natural_key"] for r in df.collect())))
            if fails:
                raise RuntimeError("the sink is down")

        options = server | {"until": until}
        readers.stream_contacts(spark, options).writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="the sink is down"):
        start(day(1), True)
    start(day(2), False)
    start(day(2), False)  # the start before may end with the batch that it had to repeat
    assert seen == [(0, ["a"]), (0, ["a"]), (1, ["b"])]


def test_tickets_are_asked_for_after_the_cursor(spark, tmp_path):
    issue = lambda n: {"key": f"T-{n}", "fields": {"summary": "s", "status": "open", "updated": f"2026-01-{n:02d}T00:00:00Z", "assignee": {"emailAddress": "a@b.c"}}}

    def exchange(issues, **params):
        return [{"path": "/search", "params": {"startAt": str(at), **params}, "body": {"startAt": at, "total": len(issues), "issues": issues[at : at + 2]}} for at in range(0, len(issues), 2)]

    found = []
    for until, exchanges in (("2026-01-03", exchange([issue(1), issue(2), issue(3)])), ("2026-01-09", exchange([issue(4)], updated_since="2026-01-03T00:00:00+00:00"))):
        server = {"exchanges": json.dumps(exchanges * 2), "waits": "false", "pageSize": "2", "tasks": "2", "until": until}
        query = readers.stream_tickets(spark, server).writeStream.foreachBatch(lambda df, i: found.append(sorted(r["natural_key"] for r in df.collect())))
        query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert found == [["T-1", "T-2", "T-3"], ["T-4"]]


def test_when_an_object_changed():
    times = ["updatedAt", "properties.at"]
    assert changed_at({"updatedAt": "", "properties": {"at": "2026-01-01"}}, times) == paged._instant("2026-01-01T00:00:00Z")
    assert changed_at({"updatedAt": "soon", "properties": {"at": "2026-01-01"}}, times) is None and changed_at({"properties": 3}, times) is None
    with pytest.raises(ValueError, match="times"):
        paged._StreamReader({})
