"""Queries over the sources: events and orders written as what a source delivers, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fields import resolve, resolve_key
from millrace.lineage import delete, own_dir, tidy
from millrace.operators.merge import apply_batch, empty_state
from millrace.operators.projections import contact_emails, deals, tickets
from millrace.plans.events import AS_OF, dealt, table
from millrace.sources.files import calendar_text, json_rows, mailbox_text, parse_calendar, parse_crm_export, parse_mailbox
from millrace.sources.files import read_crm_export
from millrace.sources.json_arrays import write_json_arrays
from millrace.sources.objects import parse_contacts, parse_deals, parse_tickets
from millrace.sources.readers import build_readers, read_ticket_export, sync_all


def _user() -> Column:
    return F.col("user_id").cast("string")


def _payload(raw: DataFrame) -> DataFrame:
    return raw.select("source", "natural_key", "kind", "occurred_at", "subject", "body", "contact_email", "contact_name", "account_name", "account_domain")


def _entries(e: DataFrame) -> DataFrame:
    """Each event as a calendar entry."""
    return e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("uid"), F.concat(F.lit("Talk; "), "event_type", F.lit(", daily")).alias("summary"),
        F.col("props").alias("description"), F.lit(None).cast("string").alias("location"), F.col("ts").cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"),
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), _user(), F.lit("@Acme.example"))).alias("organizer_email"),
        F.concat(F.lit("User "), _user()).alias("organizer_name"), F.when(F.col("event_id") % 3 == 0, "Acme").alias("account_name"),
    )


def _mails(e: DataFrame) -> DataFrame:
    """Each event as a mail."""
    return e.select(
        F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit("@example>")).alias("message_id"), F.concat(F.lit("u"), _user(), F.lit("@Acme.example")).alias("from_email"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("User "), _user())).alias("from_name"), F.lit("me@example.com").alias("to"), F.col("event_type").alias("subject"),
        F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")).alias("date"), F.concat(F.lit("From here on\n"), "props").alias("body"), F.lit(None).cast("string").alias("account_name"),
    )


def calendar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a calendar entry, written and read."""
    entries = _entries(dealt(table(spark, sf_dir, "events")))
    return _payload(parse_calendar(calendar_text(entries).select(F.regexp_replace("value", "^BEGIN:VEVENT", "").alias("value"))))


def mailbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a mail, written and read."""
    mails = _mails(dealt(table(spark, sf_dir, "events")))
    return _payload(parse_mailbox(mailbox_text(mails).select(F.regexp_replace("value", "^From ", "").alias("value"))))


def multipart_mail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of two parts, with a folded header and a name in quotes; of every third the parts are not closed."""
    e = dealt(table(spark, sf_dir, "events"))
    n = F.col("event_id").cast("string")
    head = F.concat(
        F.lit("MAILER\nMessage-ID: <"), n, F.lit(">\nFrom: \"Doe, "), n, F.lit("\" <u"), _user(), F.lit("@Mail.example>\nSubject: a long\n  subject\nDate: "),
        F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200\nContent-Type: multipart/mixed; boundary=\"B"), n, F.lit("\"\n"),
    )
    part = lambda text: F.concat(F.lit("\n--B"), n, F.lit("\nContent-Type: text/plain\n\n"), text)
    mail = F.concat(head, part(F.col("event_type")), part(F.col("props")), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("\n--B"), n, F.lit("--"))), F.lit("\n"))
    return _payload(parse_mailbox(e.select(mail.alias("value")))).select("natural_key", "occurred_at", "subject", "body", "contact_email", "contact_name", "account_name")


def ticket_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records of all issues, as validation gets them."""
    raw = parse_tickets(_issues(spark, sf_dir).select("value"))
    return _payload(raw).withColumn("lost", F.col("occurred_at") == "")


def crm_export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as an export, some with null, missing or malformed fields."""
    e, odd = dealt(table(spark, sf_dir, "events")), F.col("event_id") % 10
    row = F.to_json(
        F.struct(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.when(odd != 1, F.lit("call")).alias("kind"),
            F.when(odd == 2, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("occurred_at"), F.col("event_type").alias("subject"),
            F.concat(F.lit("u"), _user(), F.lit("@Acme.example")).alias("contact_email"), F.when(odd == 3, "Acme").alias("account_name"),
        )
    )
    spelt = F.when(odd == 4, F.regexp_replace(row, r'^\{', '{"body":null,')).otherwise(row)
    files = e.groupBy("user_id").agg(F.concat(F.lit("[1, "), F.array_join(F.collect_list(spelt), ","), F.lit(', "x"]')).alias("value"))
    return _payload(parse_crm_export(json_rows(files)))


def _folder(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}"


def crm_export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as files of JSON arrays, with texts that hold braces, brackets and quotes; written, and read in ranges."""
    c, path = table(spark, sf_dir, "conversations"), _folder(spark)
    text = F.concat(F.lit('"},{"['), F.coalesce("text", F.lit("")), F.lit('\\"]}'))
    row = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("record_id"), F.lit("2024-01-02T03:04:05Z").alias("occurred_at"),
        F.col("role").alias("subject"), text.alias("body"), F.array(F.struct(F.col("turn").alias("n"))).alias("more"), F.concat("role", F.lit("@Acme.example")).alias("contact_email"),
    )
    write_json_arrays(c.select(F.to_json(row).alias("value")), path)
    return _payload(read_crm_export(spark, path)).select("natural_key", "kind", "occurred_at", "subject", "body", "contact_email", "account_domain")


def ticket_export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues as files of JSON arrays, written and read."""
    path = _folder(spark)
    write_json_arrays(_issues(spark, sf_dir), path)
    return _payload(read_ticket_export(spark, path)).withColumn("lost", F.col("occurred_at") == "")


def sync_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a calendar, a mailbox and an export in one folder; the activities after a run over the readers of it.

    The files are of the rows of a task each, so they can be compressed; they are deleted when the run has read them.
    """
    e, folder = dealt(table(spark, sf_dir, "events")), _folder(spark)
    with tidy(spark):
        calendar_text(_entries(e)).write.text(f"{folder}/calendar.ics", compression="gzip")
        mailbox_text(_mails(e)).write.text(f"{folder}/mailbox.mbox", compression="gzip")
    row = F.struct(
        F.col("event_id").cast("string").alias("record_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), F.col("props").alias("body"),
        F.concat(F.lit("u"), _user(), F.lit("@Acme.example")).alias("contact_email"),
    )
    write_json_arrays(e.select(F.to_json(row).alias("value")), f"{folder}/crm_export.json", "gzip")
    state, _ = sync_all(empty_state(spark), build_readers(spark, folder), AS_OF)
    delete(spark, folder)
    return state["activities"].select("source", "natural_key", "kind", "subject", "body", "contact_email", "account_name", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a ticket in one of four shapes: as declared, renamed and retyped, with unknown fields, or without a required one."""
    e, shape = dealt(table(spark, sf_dir, "events")), F.col("event_id") % 4
    key, at = F.concat(F.lit("T-"), F.col("event_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    who = F.concat(F.lit("first.u"), _user(), F.lit("@acme.example"))
    due = F.date_format("ts", "yyyy-MM-dd")
    status = F.when(F.col("value") < 50, "Done").otherwise("open")
    plain = F.struct(F.col("event_type").alias("summary"), status.alias("status"), F.struct(who.alias("emailAddress")).alias("assignee"), due.alias("duedate"), at.alias("updated"), F.lit("M1").alias("milestone"))
    renamed = F.struct(F.col("event_type").alias("title"), F.struct(status.alias("name")).alias("state"), who.alias("assignee_email"), due.alias("dueDate"), at.alias("updated_at"))
    unknown = F.struct(F.col("event_type").alias("summary"), status.alias("status"), F.struct(who.alias("emailAddress")).alias("assignee"), at.alias("updated"), F.lit(3).alias("zeta"), F.lit("é").alias("alpha"))
    without = F.struct(F.col("event_type").alias("summary"), at.alias("updated"))
    text = F.when(shape == 0, F.to_json(plain)).when(shape == 1, F.to_json(renamed)).when(shape == 2, F.to_json(unknown)).otherwise(F.to_json(without))
    name = F.when(shape == 1, "issueKey").otherwise("key")
    return e.select("event_id", F.concat(F.lit('{"'), name, F.lit('":"'), key, F.lit('","fields":'), text, F.lit("}")).alias("value"))


def drift_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _issues(spark, sf_dir).select("event_id", resolve(F.get_json_object("value", "$.fields")).alias("f"), resolve_key(F.col("value")).alias("k"))
    line = lambda notes: F.array_join(F.transform(notes, lambda n: F.concat_ws("|", n["kind"], n["field"], n["detail"])), ";")
    return rows.select(
        "event_id", F.col("k.key").alias("key"), F.col("f.summary").alias("summary"), F.col("f.status").alias("status"), F.col("f.assignee_email").alias("assignee"),
        F.col("f.due_date").alias("due"), F.col("f.unmapped_json").alias("unmapped"), F.col("f.missing").alias("missing"), line(F.concat("k.drift", "f.drift")).alias("notes"),
    )


def ticket_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after a sync of all issues."""
    state, _ = apply_batch(empty_state(spark), parse_tickets(_issues(spark, sf_dir).select("value")), now=AS_OF)
    board = tickets(state["activities"])
    return board.select("ticket_key", "summary", "status", "is_open", "assignee_email", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"), "milestone_key", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def crm_deal_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contacts, orders as deals of them: contacts land first, and a deal whose contact has no email is refused."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    bad = F.col("c_custkey") % 5 == 0
    contact = F.to_json(
        F.struct(
            F.col("c_custkey").cast("string").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("updatedAt"),
            F.struct(F.when(~bad, F.concat(F.lit("c.d"), F.col("c_custkey").cast("string"), F.lit("@acme.example"))).alias("email"), F.col("c_name").alias("firstname")).alias("properties"),
        )
    )
    deal = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("id"),
            F.struct(F.when(F.col("o_orderstatus") == "F", "ClosedWon").otherwise("open").alias("dealstage"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("hs_lastmodifieddate")).alias("properties"),
            F.struct(F.struct(F.array(F.struct((F.col("o_custkey") * 0 - 1).alias("id")), F.struct(F.col("o_custkey").alias("id"))).alias("results")).alias("contacts")).alias("associations"),
        )
    )
    state, _ = apply_batch(empty_state(spark), parse_contacts(c.select(contact.alias("value"))), now=AS_OF)
    raw = parse_deals(o.select(deal.alias("value")), contact_emails(state["activities"]))
    after, _ = apply_batch(state, raw, now=AS_OF)
    return deals(after["activities"]).select("deal_id", "stage", "contact_email", "is_open", "unmapped_json")


QUERIES = {
    "calendar_scan": calendar_scan,
    "mailbox_scan": mailbox_scan,
    "crm_export_scan": crm_export_scan,
    "multipart_mail_scan": multipart_mail_scan,
    "ticket_records": ticket_records,
    "drift_resolve": drift_resolve,
    "ticket_board": ticket_board,
    "crm_deal_resolution": crm_deal_resolution,
    "crm_export_file": crm_export_file,
    "ticket_export_file": ticket_export_file,
    "sync_of_files": sync_of_files,
}

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
ORACLE_SQL = {
    "calendar_scan": f"""
        SELECT 'calendar' AS source, 'ev-' || event_id AS natural_key, 'meeting' AS kind, {_ISO} AS occurred_at, 'Talk; ' || event_type || ', daily' AS subject, props AS body,
               CASE WHEN event_id % 10 <> 0 THEN 'u' || user_id || '@Acme.example' ELSE '' END AS contact_email, CASE WHEN event_id % 10 <> 0 THEN 'User ' || user_id ELSE '' END AS contact_name,
               CASE WHEN event_id % 3 = 0 THEN 'Acme' WHEN event_id % 10 <> 0 THEN 'acme.example' ELSE '' END AS account_name,
               CASE WHEN event_id % 10 <> 0 THEN 'acme.example' ELSE '' END AS account_domain FROM events""",
    "mailbox_scan": f"""
        SELECT 'email' AS source, '<' || event_id || '@example>' AS natural_key, 'email' AS kind, CASE WHEN event_id % 10 <> 0 THEN {_ISO} END AS occurred_at,
               event_type AS subject, '>From here on' || chr(10) || props AS body, 'u' || user_id || '@Acme.example' AS contact_email,
               CASE WHEN event_id % 2 = 0 THEN 'User ' || user_id ELSE '' END AS contact_name, 'acme.example' AS account_name, 'acme.example' AS account_domain FROM events""",
    "multipart_mail_scan": """
        SELECT '<' || event_id || '>' AS natural_key, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS occurred_at, 'a long subject' AS subject,
               CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || chr(10) || props END AS body, 'u' || user_id || '@Mail.example' AS contact_email, 'Doe, ' || event_id AS contact_name,
               'mail.example' AS account_name FROM events""",
    "ticket_records": """
        SELECT 'tickets' AS source, 'T-' || event_id AS natural_key, 'ticket' AS kind, CASE WHEN lost THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS occurred_at,
               CASE WHEN lost THEN '' ELSE event_type END AS subject, CASE WHEN lost THEN '' ELSE 'SYNTHETIC ticket T-' || event_id || ' status=' || CASE WHEN value < 50 THEN 'Done' ELSE 'open' END END AS body,
               CASE WHEN lost THEN '' ELSE 'first.u' || user_id || '@acme.example' END AS contact_email, CASE WHEN lost THEN '' ELSE 'First U' || user_id END AS contact_name,
               CASE WHEN lost THEN '' ELSE 'acme.example' END AS account_name, CASE WHEN lost THEN '' ELSE 'acme.example' END AS account_domain, lost
        FROM (SELECT *, event_id % 4 = 3 AS lost FROM events)""",
    "crm_export_scan": f"""
        SELECT 'crm_import' AS source, 'r' || event_id AS natural_key, CASE WHEN event_id % 10 = 1 THEN 'note' ELSE 'call' END AS kind,
               CASE WHEN event_id % 10 = 2 THEN 'soon' ELSE {_ISO} END AS occurred_at, event_type AS subject, CASE WHEN event_id % 10 = 4 THEN 'None' ELSE '' END AS body,
               'u' || user_id || '@Acme.example' AS contact_email, '' AS contact_name, CASE WHEN event_id % 10 = 3 THEN 'Acme' ELSE 'acme.example' END AS account_name,
               'acme.example' AS account_domain FROM events""",
    "drift_resolve": r"""
        SELECT event_id, 'T-' || event_id AS key, CASE WHEN s = 3 THEN event_type ELSE event_type END AS summary, CASE WHEN s = 3 THEN '' WHEN value < 50 THEN 'Done' ELSE 'open' END AS status,
               CASE WHEN s = 3 THEN '' ELSE 'first.u' || user_id || '@acme.example' END AS assignee, CASE WHEN s < 2 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS due,
               CASE WHEN s = 2 THEN '{"alpha": "\u00e9", "zeta": 3}' ELSE '{}' END AS unmapped, CASE WHEN s = 3 THEN 'status' END AS missing,
               CASE s WHEN 0 THEN 'alias_used|milestone_key|arrived as ''milestone'', expected ''customfield_milestone'''
                      WHEN 1 THEN 'alias_used|key|arrived as ''issueKey'', expected ''key'';alias_used|summary|arrived as ''title'', expected ''summary'';alias_used|status|arrived as ''state'', expected ''status'';type_coerced|status|arrived as object, contract declares scalar;alias_used|assignee_email|arrived as ''assignee_email'', expected ''assignee'';type_coerced|assignee_email|arrived as scalar, contract declares object;alias_used|due_date|arrived as ''dueDate'', expected ''duedate'';alias_used|updated|arrived as ''updated_at'', expected ''updated'''
                      WHEN 2 THEN 'unknown_field|alpha|field not in the declared contract, kept unmapped;unknown_field|zeta|field not in the declared contract, kept unmapped' ELSE '' END AS notes
        FROM (SELECT *, event_id % 4 AS s FROM events)""",
    "ticket_board": """
        SELECT 'T-' || event_id AS ticket_key, event_type AS summary, CASE WHEN value < 50 THEN 'Done' ELSE 'open' END AS status, value >= 50 AS is_open,
               'first.u' || user_id || '@acme.example' AS assignee_email, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%Y-%m-%d') END AS due_date,
               CASE WHEN event_id % 4 = 0 THEN 'M1' ELSE '' END AS milestone_key, date_trunc('second', ts) AS updated_at FROM events WHERE event_id % 4 <> 3""",
    "crm_deal_resolution": """
        SELECT CAST(o_orderkey AS VARCHAR) AS deal_id, CASE WHEN o_orderstatus = 'F' THEN 'ClosedWon' ELSE 'open' END AS stage, 'c.d' || c_custkey || '@acme.example' AS contact_email,
               o_orderstatus <> 'F' AS is_open, '{"associated_contact_ids":"-1,' || o_custkey || '"}' AS unmapped_json
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0""",
    "crm_export_file": r"""
        SELECT 'c' || conv_id || '-' || turn AS natural_key, 'note' AS kind, '2024-01-02T03:04:05+00:00' AS occurred_at, role AS subject, '"},{"[' || coalesce(text, '') || '\"]}' AS body,
               role || '@Acme.example' AS contact_email, 'acme.example' AS account_domain FROM conversations""",
    "sync_of_files": """
        SELECT 'calendar' AS source, 'ev-' || event_id AS natural_key, 'meeting' AS kind, 'Talk; ' || event_type || ', daily' AS subject, props AS body, 'u' || user_id || '@Acme.example' AS contact_email,
               CASE WHEN event_id % 3 = 0 THEN 'Acme' ELSE 'acme.example' END AS account_name, date_trunc('second', ts) AS occurred_at FROM events WHERE event_id % 10 <> 0
        UNION ALL SELECT 'email', '<' || event_id || '@example>', 'email', event_type, '>From here on' || chr(10) || props, 'u' || user_id || '@Acme.example', 'acme.example', date_trunc('second', ts)
        FROM events WHERE event_id % 10 <> 0
        UNION ALL SELECT 'crm_import', CAST(event_id AS VARCHAR), 'note', '', props, 'u' || user_id || '@Acme.example', 'acme.example', date_trunc('second', ts) FROM events""",
}
ORACLE_SQL["ticket_export_file"] = ORACLE_SQL["ticket_records"]
