from __future__ import annotations

import json
import mailbox
import threading
from datetime import datetime
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from millrace.functions.fields import TICKET, resolve, resolve_key
from millrace.functions.retry import SourceFailure
from millrace.model import TABLES
from millrace.operators.merge import apply_batch, empty_state, reprocess
from millrace.operators.projections import contact_emails, deals, merge_milestones, tickets
from millrace.plans.events import dealt
from millrace.sources import files, objects, paged
from millrace.sources.readers import build_readers, sync_all

NOW = datetime(2026, 5, 1)

ICS = (
    "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"
    "BEGIN:VEVENT\r\nUID:e1\r\nSUMMARY:Talk\\, long\r\n er\r\nDESCRIPTION:a\\nb\r\nDTSTART:20260302T090000Z\r\n"
    'ORGANIZER;CN="Ann B":MAILTO:ann@Acme.example\r\nX-ACCOUNT-NAME:Acme\r\nEND:VEVENT\r\n'
    "BEGIN:VEVENT\r\nUID:e2\r\nDTSTART;VALUE=DATE:20260303\r\nORGANIZER:mailto:bob@b.example\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nUID:e3\r\nDTSTART;TZID=Europe/Berlin:20260304T100000\r\nEND:VEVENT\r\n"
    "BEGIN:VEVENT\r\nSUMMARY:no uid, no time\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
)


def rows_by_key(df):
    return {r["natural_key"]: r for r in df.collect()}


def test_calendar(spark, tmp_path):
    path = tmp_path / "calendar.ics"
    path.write_bytes(ICS.encode())
    got = rows_by_key(files.read_calendar(spark, str(path)))
    assert set(got) == {"e1", "e2", "e3", None}
    e1 = got["e1"]
    assert (e1["occurred_at"], e1["subject"], e1["body"]) == ("2026-03-02T09:00:00+00:00", "Talk, longer", "a\nb")
    assert (e1["contact_email"], e1["contact_name"], e1["account_name"], e1["account_domain"]) == ("ann@Acme.example", "Ann B", "Acme", "acme.example")
    assert (got["e2"]["occurred_at"], got["e2"]["account_name"], got["e2"]["contact_name"]) == ("2026-03-03T00:00:00+00:00", "b.example", "")
    assert got["e3"]["occurred_at"] == "2026-03-04T09:00:00+00:00" and got[None]["occurred_at"] is None
    later = rows_by_key(files.read_calendar(spark, str(path), datetime(2026, 3, 3)))
    assert set(later) == {"e3", None}


def test_mailbox(spark, tmp_path):
    path = tmp_path / "mailbox.mbox"
    box = mailbox.mbox(str(path))
    plain = mailbox.mboxMessage()
    plain["Message-ID"], plain["From"], plain["Subject"] = " <m1@x> ", '"Ann B" <ann@Acme.example>', "Hi"
    plain["Date"] = "Mon, 02 Mar 2026 10:30:00 +0130"
    plain.set_payload("one\nFrom here on\ntwo\n")
    parts = MIMEMultipart()
    parts["Message-ID"], parts["From"], parts["Date"], parts["X-Account-Name"] = "<m2@x>", "bob@b.example", "not a date", "Bob & Co"
    parts.attach(MIMEText("first"))
    parts.attach(MIMEText("second"))
    bare = mailbox.mboxMessage()
    bare["Date"] = "Tue, 3 Mar 2026 01:02:03 GMT (comment)"
    bare.set_payload("x")
    for m in (plain, mailbox.mboxMessage(parts), bare):
        box.add(m)
    box.flush()
    got = rows_by_key(files.read_mailbox(spark, str(path)))
    assert set(got) == {"<m1@x>", "<m2@x>", None}
    m1, m2 = got["<m1@x>"], got["<m2@x>"]
    assert (m1["occurred_at"], m1["contact_email"], m1["contact_name"], m1["account_name"]) == ("2026-03-02T09:00:00+00:00", "ann@Acme.example", "Ann B", "acme.example")
    assert m1["body"] == next(iter(mailbox.mbox(str(path)))).get_payload().strip() == "one\n>From here on\ntwo"
    assert (m2["occurred_at"], m2["body"], m2["account_name"]) == (None, "first\nsecond", "Bob & Co")
    assert got[None]["occurred_at"] == "2026-03-03T01:02:03+00:00"
    assert set(rows_by_key(files.read_mailbox(spark, str(path), datetime(2026, 3, 2, 9)))) == {"<m2@x>", None}


def test_crm_export(spark, tmp_path):
    path = tmp_path / "crm_export.json"
    rows = [
        {"record_id": "r1", "occurred_at": "2026-03-02T09:00:00+01:00", "contact_email": "a@B.example", "subject": None},
        {"record_id": 7, "occurred_at": "soon", "kind": "call"}, {"occurred_at": None}, "text", 5, {"record_id": "r4", "occurred_at": ""},
    ]
    path.write_text(json.dumps(rows, indent=2))
    got = rows_by_key(files.read_crm_export(spark, str(path)))
    assert set(got) == {"r1", "7", None, "r4"}
    r1 = got["r1"]
    assert (r1["kind"], r1["occurred_at"], r1["subject"], r1["account_name"], r1["account_domain"]) == ("note", "2026-03-02T08:00:00+00:00", "None", "b.example", "b.example")
    assert (got["7"]["kind"], got["7"]["occurred_at"]) == ("call", "soon")
    assert set(rows_by_key(files.read_crm_export(spark, str(path), datetime(2026, 3, 2, 8)))) == {"7", None}
    path.write_text('{"record_id": "x"}')
    assert files.read_crm_export(spark, str(path)).isEmpty()


def test_one_run_over_all_files(spark, tmp_path):
    (tmp_path / "calendar.ics").write_bytes(ICS.encode())
    (tmp_path / "mailbox.mbox").write_text("From x\nMessage-ID: <m@x>\nFrom: a@b.example\nDate: Mon, 02 Mar 2026 09:00:00 +0000\n\nhello\n")
    (tmp_path / "crm_export.json").write_text("[]")
    readers = build_readers(spark, str(tmp_path))
    state, stats = sync_all(empty_state(spark), readers, NOW)
    assert {r["source"]: r["created"] for r in stats.collect()} == {"calendar": 2, "email": 1}
    assert {r["source"]: r["cursor"] for r in state["cursors"].collect()} == {"calendar": datetime(2026, 3, 3), "email": datetime(2026, 3, 2, 9), "crm_import": None}
    _, stats = sync_all(state, readers, NOW)
    assert stats.filter("created + updated + unchanged > 0").isEmpty()


def test_written_entries_read_back(spark, tmp_path):
    one = spark.createDataFrame(
        [("u1", "a, b; c", "x\ny", None, datetime(2026, 3, 2, 9), None, "a@b.example", "Ann", None)],
        "uid string, summary string, description string, location string, start timestamp, end timestamp, organizer_email string, organizer_name string, account_name string",
    )
    files.calendar_text(one).write.text(str(tmp_path / "ics"))
    got = files.read_calendar(spark, str(tmp_path / "ics")).first()
    assert (got["natural_key"], got["subject"], got["body"], got["contact_name"]) == ("u1", "a, b; c", "x\ny", "Ann")


def resolved(spark, *bags):
    rows = spark.createDataFrame([(i, None if b is None else json.dumps(b)) for i, b in enumerate(bags)], "i int, v string")
    return [r["f"] for r in sorted(rows.select("i", resolve(F.col("v"), TICKET).alias("f")).collect())]


GOOD = {"summary": "s", "status": "Open", "assignee": {"emailAddress": "a@b.c"}, "updated": "2026-03-01"}


def notes(f):
    return [(d["kind"], d["field"]) for d in f["drift"]]


def test_contract(spark):
    plain, renamed, nulls, gone, nothing = resolved(
        spark, GOOD, {"title": " s ", "state": {"name": "", "value": "Done"}, "assigneeAccount": "a@b.c", "updatedAt": "x", "zz": [1], "Aa": {"k": 1}},
        {"summary": None, "title": "t", "status": 5, "assignee": None, "updated": ""}, {"summary": "s", "updated": "u"}, None,
    )
    assert (plain["summary"], plain["status"], plain["assignee_email"], plain["unmapped_json"], plain["missing"], notes(plain)) == ("s", "Open", "a@b.c", "{}", None, [])
    assert (renamed["summary"], renamed["status"], renamed["assignee_email"]) == ("s", "Done", "a@b.c")
    assert notes(renamed) == [
        ("alias_used", "summary"), ("alias_used", "status"), ("type_coerced", "status"), ("alias_used", "assignee_email"), ("type_coerced", "assignee_email"), ("alias_used", "updated"),
        ("unknown_field", "Aa"), ("unknown_field", "zz"),
    ]
    assert json.loads(renamed["unmapped_json"]) == {"Aa": {"k": 1}, "zz": [1]}
    assert (nulls["summary"], nulls["status"], nulls["missing"]) == ("", "5", None)
    assert notes(nulls) == [("type_coerced", "assignee_email"), ("unknown_field", "title")]
    assert gone["missing"] == "status" and nothing["missing"] == "summary"


def test_key_spellings(spark):
    texts = ['{"key":"K-1","id":"9"}', '{"key":"","issue_key":"K-2"}', '{"id":7}', '{"fields":{}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", resolve_key(F.col("v")).alias("k")).collect()
    got = [(r["k"]["key"], [d["kind"] for d in r["k"]["drift"]]) for r in sorted(rows)]
    assert got == [("K-1", []), ("K-2", ["alias_used"]), ("7", ["alias_used"]), ("", ["missing_required"])]


def issue(key, **fields):
    return (json.dumps({"key": key, "fields": GOOD | fields}),)


def test_tickets(spark):
    lost = (json.dumps({"key": "T3", "fields": {"summary": "s", "updated": "2026-03-01"}}),)
    board = spark.createDataFrame([issue("T1", duedate="2026-03-05", customfield_milestone="M1"), issue("T2", status="closed", duedate="soon"), lost], "value string")
    state, stats = apply_batch(empty_state(spark), objects.parse_tickets(board), now=NOW)
    got = {r["ticket_key"]: r for r in tickets(state["activities"]).collect()}
    assert set(got) == {"T1", "T2"} and got["T1"]["is_open"] and not got["T2"]["is_open"]
    assert (str(got["T1"]["due_date"]), got["T1"]["milestone_key"], got["T2"]["due_date"], got["T2"]["due_text"]) == ("2026-03-05", "M1", None, "soon")
    dead = state["dead_letter"].first()
    assert (dead["natural_key"], dead["error"]) == ("T3", "missing occurred_at timestamp") and '"status' in json.dumps(json.loads(dead["payload_json"])["drift"]).replace("'", '"')
    renamed = spark.createDataFrame([(board.first()["value"].replace('"summary"', '"title"'),)], "value string")
    again, stats = apply_batch(state, objects.parse_tickets(renamed), now=NOW)
    assert stats.first()["unchanged"] == 1
    assert "alias_used: summary (arrived as 'title', expected 'summary')" in [r["detail"] for r in again["audit"].filter("action = 'schema_drift'").collect()]
    assert objects.tickets_after(board, datetime(2026, 3, 1)).isEmpty() and objects.tickets_after(board, datetime(2026, 2, 28)).count() == 3


def contact(i, email, **more):
    return {"id": str(i), "properties": {"email": email, "firstname": "Ann", "lastname": "Bee", "lastmodifieddate": "2026-03-01T00:00:00Z"}, "updatedAt": "2026-03-02T00:00:00Z"} | more


def exchange(body, status=200, headers=None, path="/objects/contacts", **params):
    return {"path": path, "params": {k: str(v) for k, v in params.items()}, "status": status, "headers": headers or {}, "body": body}


def pages_of(spark, exchanges, **options):
    return objects_of(spark, exchanges, **options).collect()


def objects_of(spark, exchanges, path="/objects/contacts", **options):
    return paged.objects(spark, path, exchanges=json.dumps(exchanges), waits="false", pageSize="2", **options)


def test_token_pages_with_refusals(spark):
    recorded = [
        exchange({"results": [contact(1, "a@b.c")], "paging": {"next": {"after": "x"}}}, limit=2), exchange({"message": "slow"}, 429, {"Retry-After": "10"}, after="x"),
        exchange({"results": [], "paging": {"next": {"after": "y"}}}, after="x"), exchange({}, 503, after="y"), exchange({"results": [contact(2, None)]}, after="y"),
    ]
    assert [json.loads(r["value"])["id"] for r in pages_of(spark, recorded)] == ["1", "2"]
    for bad, said in (
        ([recorded[0]], "unrecorded"), ([recorded[0], exchange({"paging": {"next": {"after": "x"}}}, after="x")], "came twice"),
        ([exchange({}, 401)], "denied"), ([exchange({}, 404)], "refused"), ([exchange({}, 429)] * 4, "throttled"),
    ):
        with pytest.raises(PythonException, match=said):
            pages_of(spark, bad)


def test_offset_pages_are_read_by_ranges(spark):
    issues = [{"key": f"T{i}"} for i in range(5)]
    page = lambda at: exchange({"startAt": at, "total": 5, "issues": issues[at : at + 2]}, path="/search", startAt=at)
    got = objects_of(spark, [page(0), page(2), page(4)], "/search", paging="offset", rows="issues", tasks="3")
    assert got.rdd.getNumPartitions() == 3 and sorted(json.loads(r["value"])["key"] for r in got.collect()) == [f"T{i}" for i in range(5)]


def test_recording_is_matched_by_parameters():
    transport = paged.Recorded([exchange({"n": 1}, after="x"), exchange({"n": 2})])
    assert transport("/objects/contacts", {})[2] == {"n": 2}
    with pytest.raises(SourceFailure, match="unrecorded"):
        transport("/objects/contacts", {"after": "z"})
    assert transport("/objects/contacts", {"after": "x"})[2] == {"n": 1}
    with pytest.raises(SourceFailure, match="came twice"):
        list(paged.token_pages(lambda _: {"paging": {"next": {"after": "a"}}}, {}))


def test_one_run_over_all_six_sources(spark, tmp_path):
    """Files from a folder, tickets and a CRM from recordings; a second run finds nothing new and reads the endpoints from the cursor."""
    (tmp_path / "calendar.ics").write_bytes(ICS.encode())
    (tmp_path / "mailbox.mbox").write_text("From x\nMessage-ID: <m@x>\nFrom: a@b.example\nDate: Mon, 02 Mar 2026 09:00:00 +0000\n\nhello\n")
    (tmp_path / "crm_export.json").write_text(json.dumps([{"record_id": "r1", "occurred_at": "2026-03-02T09:00:00Z", "contact_email": "a@b.example"}]))
    issue = {"key": "T1", "fields": {"summary": "s", "status": "open", "updated": "2026-03-04T00:00:00Z", "assignee": {"emailAddress": "a@b.example"}}}
    deal = {"id": "d1", "updatedAt": "2026-03-05T00:00:00Z", "properties": {"dealname": "D"}, "associations": {"contacts": {"results": [{"id": "1"}]}}}
    board = [exchange({"startAt": 0, "total": 1, "issues": [issue]}, path="/search", startAt=0)] * 2
    crm = [exchange({"results": [contact(1, "a@b.example")]}, path="/crm/v3/objects/contacts"), exchange({"results": [deal]}, path="/crm/v3/objects/deals")]
    for name, exchanges in (("tickets", board), ("crm", crm)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"exchanges": exchanges}))
    servers = {name: paged.endpoint(spark, recordings=(str(tmp_path / f"{name}.json"),)) for name in ("tickets", "crm")}
    readers = build_readers(spark, str(tmp_path), **servers)
    state, stats = sync_all(empty_state(spark), readers, NOW)
    assert {r["source"]: r["n"] for r in stats.groupBy("source").agg(F.sum("created").alias("n")).collect()} == {"calendar": 2, "email": 1, "crm_import": 1, "tickets": 1, "hubspot_contacts": 1, "hubspot_deals": 1}
    assert {r["source"] for r in state["cursors"].filter("cursor is not null").collect()} == set(readers)
    _, stats = sync_all(state, readers, NOW)
    assert stats.filter("created + updated + unchanged > 0").isEmpty()
    for wrong in ({}, {"url": "http://x", "recordings": ("y",)}):
        with pytest.raises(ValueError, match="either"):
            paged.endpoint(spark, **wrong)


def test_a_live_server_is_asked_by_http(spark):
    """A server of this machine that refuses its second page once, is out of order once, and ends with an error for another path."""
    asked, failures = [], [(429, {"Retry-After": "0"}), (503, {})]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlsplit(self.path)
            after = parse_qs(url.query).get("after", [None])[0]
            asked.append((url.path, after, self.headers["Authorization"].split()[0]))
            status, headers, body = 200, {}, {"results": [{"id": "1"}], "paging": {"next": {"after": "x"}}} if after is None else {"results": [{"id": "2"}]}
            if after and failures:
                (status, headers), body = failures.pop(0), {}
            if url.path == "/gone":
                status, body = 404, {}
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        options = paged.endpoint(spark, url=f"http://127.0.0.1:{server.server_port}/", base="0.01")
        got = paged.objects(spark, "/objects", **options).collect()
        assert [(json.loads(r["value"])["id"], r["arrival"]) for r in got] == [("1", 0), ("2", 1)]
        assert asked == [("/objects", None, "Bearer")] + [("/objects", "x", "Bearer")] * 3
        with pytest.raises(PythonException, match="refused"):
            paged.objects(spark, "/gone", **options).collect()
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(PythonException, match="outage"):
        paged.objects(spark, "/objects", **paged.endpoint(spark, url=f"http://127.0.0.1:{server.server_port}", base="0.01", attempts="2")).collect()


def test_deals_need_their_contacts_first(spark):
    deal = lambda i, ids: (json.dumps({"id": str(i), "properties": {"dealname": f"D{i}", "dealstage": "ClosedWon" if i == 1 else "open", "amount": "10.50", "hs_lastmodifieddate": "2026-03-03"}, "associations": {"contacts": {"results": [{"id": x} for x in ids]}}}),)  # noqa: E731, E501
    board = spark.createDataFrame([deal(1, ["9", "2", "1"]), deal(2, ["9"]), (json.dumps({"id": "3", "associations": []}),)], "value string")
    state, _ = apply_batch(empty_state(spark), objects.parse_contacts(spark.createDataFrame([(json.dumps(contact(1, "a@b.c")),), (json.dumps(contact(2, "x.y@b.c")),), (json.dumps(contact(4, None)),)], "value string")), now=NOW)
    landed = {r["natural_key"]: r for r in state["activities"].collect()}
    assert set(landed) == {"1", "2"} and landed["1"]["subject"] == "Contact Ann Bee" and landed["1"]["account_name"] == "b.c"
    after, _ = apply_batch(state, objects.parse_deals(board, contact_emails(state["activities"])), now=NOW)
    got = {r["deal_id"]: r for r in deals(after["activities"]).collect()}
    assert set(got) == {"1"} and (got["1"]["contact_email"], got["1"]["is_open"], got["1"]["amount"]) == ("x.y@b.c", False, "10.50")
    assert {r["natural_key"] for r in after["dead_letter"].collect()} == {"2", "3", "4"}
    assert reprocess(after, now=NOW)["dead_letter"].filter("resolved").isEmpty()


def test_milestone_file(spark, tmp_path):
    path = tmp_path / "plan.json"
    path.write_text(json.dumps([{"milestone_key": "a", "planned_end": "2026-03-01", "depends_on": ["b"]}, {"milestone_key": "b", "planned_end": "2026-02-01", "actual_end": "", "status": "done"}]))
    none = [spark.createDataFrame([], TABLES[n]) for n in ("milestones", "milestone_deps")]
    rows, deps = merge_milestones(*none, files.read_milestones(spark, str(path)))
    got = {r["milestone_key"]: r for r in rows.collect()}
    assert (got["a"]["status"], str(got["a"]["planned_end"]), got["b"]["actual_end"]) == ("planned", "2026-03-01", None)
    assert [tuple(r) for r in deps.collect()] == [("a", "b")]


def test_rows_of_one_row_group_are_dealt_over_all_tasks(spark, tmp_path):
    """A file of one row group is read in many parts, of which one has all rows."""
    spark.range(40_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    try:
        given = spark.read.parquet(f"{tmp_path}/one")
        assert given.rdd.getNumPartitions() > 8
        found = [r["count"] for r in dealt(given, task_rows=5_000).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(found) == 40_000 and max(found) <= 5_500
        assert dealt(given.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
