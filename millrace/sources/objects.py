"""Tickets, contacts and deals as raw records: rows of JSON objects, whatever brought them, resolved by columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.fields import TICKET, Contract, note, resolve, resolve_key
from millrace.functions.scalars import after_at, closed_stage, closed_status, iso_text, name_of_email, strip, text_or, utc_timestamp
from millrace.model import CRM_CONTACTS, CRM_DEALS, DRIFT, MISSING_REQUIRED, TICKETS
from millrace.operators.projections import first_existing
from millrace.sources.files import raw_row, with_arrival

# The properties that are asked of the CRM.
CONTACT_PROPERTIES = ("email", "firstname", "lastname", "company", "jobtitle", "lifecyclestage", "lastmodifieddate")
DEAL_PROPERTIES = ("dealname", "dealstage", "pipeline", "amount", "closedate", "hubspot_owner_id", "hs_lastmodifieddate")


def _extra(**fields: Column) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def updated_of(issue: Column) -> Column:
    """When an issue says it was updated, as canonical text where it can be read; empty if it does not say."""
    held = [F.nullif(F.get_json_object(issue, f"$.fields.{name}"), F.lit("")) for name in ("updated", "updated_at", "updatedAt")]
    first = F.coalesce(*held, F.lit(""))
    return F.coalesce(iso_text(utc_timestamp(first)), first)


def tickets_after(issues: DataFrame, since: datetime | None) -> DataFrame:
    """The issues that the endpoint gives after a cursor; those that do not say when they were updated are left out then."""
    return issues if since is None else issues.filter(updated_of(F.col("value")) > iso_text(F.lit(since).cast("timestamp")))


def parse_tickets(issues: DataFrame, contract: Contract = TICKET) -> DataFrame:
    """Raw records of issues. issues: value, the JSON text of one.

    An issue without a required field has no time, so that validation refuses it, and a drift note that says why; its
    texts are kept in ``raw_json`` of extra, so that it can be resolved again.
    """
    rows = with_arrival(issues).select("arrival", "value", resolve_key(F.col("value")).alias("k"), resolve(F.get_json_object("value", "$.fields"), contract).alias("f"))
    lost = F.col("f.missing").isNotNull()
    own = lambda c: F.when(lost, F.lit("")).otherwise(F.col(f"f.{c}"))
    key, email, status = F.col("k.key"), own("assignee_email"), own("status")
    account = text_or(own("account_name"), after_at(email))
    at = F.coalesce(iso_text(utc_timestamp(own("updated"))), own("updated"))
    gone = F.concat(F.lit("required field '"), F.col("f.missing"), F.lit("' missing under every known alias"))
    notes = F.when(lost, F.array(note(MISSING_REQUIRED, F.col("f.missing"), gone)).cast(DRIFT)).otherwise(F.col("f.drift"))
    extra = _extra(
        ticket_key=key, status=status, is_open=F.when(closed_status(status), "0").otherwise("1"), due_date=own("due_date"),
        milestone_key=own("milestone_key"), unmapped_json=F.col("f.unmapped_json"),
    )
    body = F.when(lost, "").otherwise(F.concat(F.lit("SYNTHETIC ticket "), key, F.lit(" status="), status))
    return rows.select(
        "arrival",
        *raw_row(
            TICKETS, F.nullif(key, F.lit("")), F.when(lost, _extra(raw_json=F.col("value"))).otherwise(extra), F.concat("k.drift", notes), kind=F.lit("ticket"), occurred_at=at,
            subject=own("summary"), body=body, contact_email=email, contact_name=name_of_email(email), account_name=account, account_domain=account,
        ),
    )


def _property(name: str) -> Column:
    return strip(F.coalesce(F.get_json_object("value", f"$.properties.{name}"), F.lit("")))


def _changed(fallback: str) -> Column:
    """updatedAt of the envelope, or the property; empty if the first that is there cannot be read."""
    given = F.coalesce(F.nullif(F.get_json_object("value", "$.updatedAt"), F.lit("")), _property(fallback))
    return F.coalesce(iso_text(utc_timestamp(given)), F.lit(""))


def _object_id() -> Column:
    return strip(F.coalesce(F.get_json_object("value", "$.id"), F.lit("")))


def parse_contacts(objects: DataFrame) -> DataFrame:
    """Raw records of the CRM's contacts. objects: value, the JSON text of one."""
    key, email, stage = _object_id(), _property("email"), _property("lifecyclestage")
    name = strip(F.concat_ws(" ", F.nullif(_property("firstname"), F.lit("")), F.nullif(_property("lastname"), F.lit(""))))
    archived = F.coalesce(F.get_json_object("value", "$.archived"), F.lit("false"))
    return with_arrival(objects).select(
        "arrival",
        *raw_row(
            CRM_CONTACTS, F.nullif(key, F.lit("")),
            _extra(hubspot_id=key, lifecyclestage=stage, jobtitle=_property("jobtitle"), archived=F.when(archived.isin("false", "0", ""), "0").otherwise("1")),
            kind=F.lit("hubspot_contact"), occurred_at=_changed("lastmodifieddate"), subject=F.concat(F.lit("Contact "), text_or(name, text_or(email, key))),
            body=F.concat(F.lit("SYNTHETIC HubSpot contact "), key, F.lit(" lifecyclestage="), text_or(stage, F.lit("unset"))),
            contact_email=email, contact_name=name, account_name=text_or(_property("company"), after_at(email)), account_domain=after_at(email),
        ),
    )


def associated_ids(value: Column, kind: str = "contacts") -> Column:
    """The ids of the associated objects in order; none where any level is absent."""
    listed = F.from_json(F.get_json_object(value, f"$.associations.{kind}.results"), "array<struct<id:string>>")
    ids = F.filter(F.transform(listed, lambda r: r["id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    return F.coalesce(ids, F.array().cast("array<string>"))


def parse_deals(objects: DataFrame, emails: DataFrame) -> DataFrame:
    """Raw records of the CRM's deals. emails: contact_id and email of the contacts that have landed.

    A deal belongs to the first of its associated contacts that has landed; one with none has no email, and validation
    refuses it until the contact is there.
    """
    rows = with_arrival(objects).withColumn("ids", associated_ids(F.col("value")))
    rows = rows.join(first_existing(rows, "arrival", "ids", emails, "contact_id", "email"), "arrival")
    key, stage, name, email = _object_id(), _property("dealstage"), _property("dealname"), F.col("email")
    return rows.select(
        "arrival",
        *raw_row(
            CRM_DEALS, F.nullif(key, F.lit("")),
            _extra(
                hubspot_id=key, dealname=name, dealstage=stage, pipeline=_property("pipeline"), amount=_property("amount"), closedate=_property("closedate"),
                owner_id=_property("hubspot_owner_id"), is_open=F.when(closed_stage(stage), "0").otherwise("1"), associated_contact_ids=F.array_join("ids", ","),
            ),
            kind=F.lit("hubspot_deal"), occurred_at=_changed("hs_lastmodifieddate"), subject=F.concat(F.lit("Deal "), text_or(name, key)),
            body=F.concat(F.lit("SYNTHETIC HubSpot deal "), key, F.lit(" stage="), text_or(stage, F.lit("unset"))),
            contact_email=email, contact_name=name_of_email(email), account_name=after_at(email), account_domain=after_at(email),
        ),
    )
