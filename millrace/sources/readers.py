"""The readers of all sources by name, and one run over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import iso_text
from millrace.model import CALENDAR, CRM_CONTACTS, CRM_DEALS, CRM_IMPORT, EMAIL, TICKETS
from millrace.operators.merge import State, apply_batch
from millrace.operators.projections import contact_emails
from millrace.sources.files import after_cursor, read_calendar, read_crm_export, read_json_rows, read_mailbox
from millrace.sources.objects import CONTACT_PROPERTIES, DEAL_PROPERTIES, parse_contacts, parse_deals, parse_tickets, tickets_after
from millrace.sources.paged import objects

#: Takes the source's cursor, and the tables as they are when it is read.
Reader = Callable[[datetime | None, State], DataFrame]

# Where the endpoints have their objects.
TICKET_PATH, CONTACT_PATH, DEAL_PATH = "/search", "/crm/v3/objects/contacts", "/crm/v3/objects/deals"


def read_tickets(spark: SparkSession, server: dict[str, str], since: datetime | None = None, path: str = TICKET_PATH) -> DataFrame:
    """Raw records of the tickets that an offset-paged endpoint has updated after the cursor. server: what endpoint() gives."""
    asked = {} if since is None else {"updated_since": since.isoformat()}
    issues = objects(spark, path, asked=asked, **{"paging": "offset", "rows": "issues"} | server)
    return parse_tickets(tickets_after(issues, since))


def read_ticket_export(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """Raw records of exported tickets: JSON arrays of issues, or an issue a line."""
    return parse_tickets(tickets_after(read_json_rows(spark, path), since))


def _changed_after(raw: DataFrame, since: datetime | None) -> DataFrame:
    """An endpoint that lists objects takes no cursor, so all pages are read and the rows are filtered; those without a time always pass."""
    return after_cursor(raw, since)


def read_contacts(spark: SparkSession, server: dict[str, str], since: datetime | None = None, path: str = CONTACT_PATH) -> DataFrame:
    """Raw records of the CRM's contacts that changed after the cursor."""
    return _changed_after(parse_contacts(objects(spark, path, properties=CONTACT_PROPERTIES, **server)), since)


def read_deals(spark: SparkSession, server: dict[str, str], emails: DataFrame, since: datetime | None = None, path: str = DEAL_PATH) -> DataFrame:
    """Raw records of the CRM's deals that changed after the cursor, each with the email of its first contact that has landed. emails: contact_emails()."""
    return _changed_after(parse_deals(objects(spark, path, properties=DEAL_PROPERTIES, associations=("contacts",), **server), emails), since)


# What says when an object changed, and the parameter that tells the ticket endpoint the cursor.
_TICKET_TIMES, _ASKS = "fields.updated,fields.updated_at,fields.updatedAt", "updated_since"
_CONTACT_TIMES, _DEAL_TIMES = "updatedAt,properties.lastmodifieddate", "updatedAt,properties.hs_lastmodifieddate"


def stream_tickets(spark: SparkSession, server: dict[str, str], path: str = TICKET_PATH) -> DataFrame:
    """The tickets of an endpoint as a stream of raw records; micro-batches follow each other by when tickets changed."""
    return parse_tickets(objects(spark, path, stream=True, **{"paging": "offset", "rows": "issues", "times": _TICKET_TIMES, "asks": _ASKS} | server))


def stream_contacts(spark: SparkSession, server: dict[str, str], path: str = CONTACT_PATH) -> DataFrame:
    """The contacts of a CRM as a stream of raw records."""
    return parse_contacts(objects(spark, path, properties=CONTACT_PROPERTIES, stream=True, **{"times": _CONTACT_TIMES} | server))


def stream_deals(spark: SparkSession, server: dict[str, str], path: str = DEAL_PATH) -> DataFrame:
    """The deals of a CRM as a stream of JSON texts and arrivals, for parse_deals() within a micro-batch, when it is known which contacts have landed."""
    return objects(spark, path, properties=DEAL_PROPERTIES, associations=("contacts",), stream=True, **{"times": _DEAL_TIMES} | server)


def build_readers(spark: SparkSession, folder: str | None = None, tickets: dict[str, str] | None = None, crm: dict[str, str] | None = None) -> dict[str, Reader]:
    """A reader for each source that is given: the three files of a folder, a ticket endpoint, and a CRM's contacts and deals."""
    out: dict[str, Reader] = {}
    if folder is not None:
        out |= {
            CALENDAR: lambda since, _: read_calendar(spark, f"{folder}/calendar.ics", since),
            EMAIL: lambda since, _: read_mailbox(spark, f"{folder}/mailbox.mbox", since),
            CRM_IMPORT: lambda since, _: read_crm_export(spark, f"{folder}/crm_export.json", since),
        }
    if tickets is not None:
        out[TICKETS] = lambda since, _: read_tickets(spark, tickets, since)
    if crm is not None:
        out[CRM_CONTACTS] = lambda since, _: read_contacts(spark, crm, since)
        out[CRM_DEALS] = lambda since, state: read_deals(spark, crm, contact_emails(state["activities"]), since)
    return out


def sync_all(state: State, readers: dict[str, Reader], now: datetime) -> tuple[State, DataFrame]:
    """A run over every reader from its cursor. Returns the tables and the run's counts per source.

    Sources whose keys never meet make one batch; deals are a batch of their own after it, as they belong to contacts
    that have landed. A source that has nothing new gets a cursor row, too.
    """
    counts = None
    for batch in (sorted(set(readers) - {CRM_DEALS}), sorted(set(readers) & {CRM_DEALS})):
        if batch:
            state, stats = _sync(state, {name: readers[name] for name in batch}, now)
            counts = stats if counts is None else counts.unionByName(stats)
    if counts is None:
        raise ValueError("no readers")
    return state, counts


def _sync(state: State, readers: dict[str, Reader], now: datetime) -> tuple[State, DataFrame]:
    cursors = {r["source"]: r["cursor"] for r in state["cursors"].filter(F.col("source").isin(*readers)).collect()}
    raw = None
    for i, (source, reader) in enumerate(readers.items()):
        part = reader(cursors.get(source), state).withColumn("arrival", F.col("arrival") + F.lit(i << 58))
        raw = part if raw is None else raw.unionByName(part)
    new, stats = apply_batch(state, raw, now=now)
    read = raw.sparkSession.createDataFrame([(s, None, now) for s in readers], new["cursors"].schema)
    new["cursors"] = new["cursors"].unionByName(read).groupBy("source").agg(F.max("cursor").alias("cursor"), F.max("updated_at").alias("updated_at"))
    return new, stats


def cursor_texts(cursors: DataFrame) -> DataFrame:
    """The cursors as canonical text, as an endpoint is asked with them."""
    return cursors.select("source", iso_text(F.col("cursor")).alias("cursor"))
