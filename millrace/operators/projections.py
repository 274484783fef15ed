"""Tickets, deals and associations as views of the activities, and the merge of a milestone plan.

A projection keeps the last version of each key that landed, which is what the activities keep; so it is a selection
of them and needs no state of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import parse_date, text_or
from millrace.model import CRM_CONTACTS, CRM_DEALS, TICKETS


def tickets(activities: DataFrame) -> DataFrame:
    """One row per ticket; due_text is as it arrived, due_date null where it is no date."""
    x = lambda k: F.coalesce(F.col("extra")[k], F.lit(""))
    return activities.filter(F.col("source") == TICKETS).select(
        text_or(x("ticket_key"), F.col("natural_key")).alias("ticket_key"), F.col("subject").alias("summary"), x("status").alias("status"),
        (text_or(x("is_open"), F.lit("1")) == "1").alias("is_open"), F.col("contact_email").alias("assignee_email"),
        x("due_date").alias("due_text"), parse_date(x("due_date")).alias("due_date"), x("milestone_key").alias("milestone_key"),
        F.col("occurred_at").alias("updated_at"), text_or(x("unmapped_json"), F.lit("{}")).alias("unmapped_json"),
    )


def deals(activities: DataFrame) -> DataFrame:
    """One row per deal; the amount stays text."""
    x = lambda k: F.coalesce(F.col("extra")[k], F.lit(""))
    return activities.filter(F.col("source") == CRM_DEALS).select(
        text_or(x("hubspot_id"), F.col("natural_key")).alias("deal_id"), x("dealname").alias("name"), x("dealstage").alias("stage"),
        x("pipeline").alias("pipeline"), x("amount").alias("amount"), x("closedate").alias("close_date"), x("owner_id").alias("owner_ref"),
        "contact_email", (text_or(x("is_open"), F.lit("1")) == "1").alias("is_open"), F.col("occurred_at").alias("updated_at"),
        F.to_json(F.struct(x("associated_contact_ids").alias("associated_contact_ids"))).alias("unmapped_json"),
    )


def first_existing(rows: DataFrame, id_col: str, ids: str, known: DataFrame, known_id: str, value: str) -> DataFrame:
    """id and value: for each row the value of the first of its listed ids that is known with a value that is not empty; empty if none is.

    rows must have one row per id. Only the ids are exploded, and what they find is aggregated before it comes back.
    """
    listed = rows.select(id_col, F.posexplode(ids).alias("pos", known_id))
    met = listed.join(known.select(known_id, value).filter(F.coalesce(value, F.lit("")) != ""), known_id)
    first = met.groupBy(id_col).agg(F.min_by(value, "pos").alias(value))
    return rows.select(id_col).join(first, id_col, "left").select(id_col, F.coalesce(value, F.lit("")).alias(value))


def contact_emails(activities: DataFrame) -> DataFrame:
    """contact_id and email of the contacts that have landed; what deals are resolved against."""
    return activities.filter(F.col("source") == CRM_CONTACTS).select(F.col("natural_key").alias("contact_id"), F.col("contact_email").alias("email"))


def merge_milestones(old: DataFrame, old_deps: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Milestones and dependencies after a plan was loaded. given: the milestones' columns and depends_on; one row per key wins over the old.

    Dependencies are added and never taken away.
    """
    deps = given.select("milestone_key", F.explode("depends_on").alias("depends_on_key")).unionByName(old_deps).distinct()
    rows = given.select(*old.columns, F.lit(1).alias("new")).unionByName(old.withColumn("new", F.lit(0)))
    rest = [c for c in old.columns if c != "milestone_key"]
    return rows.groupBy("milestone_key").agg(F.max_by(F.struct(*rest), "new").alias("v")).select("milestone_key", "v.*").select(*old.columns), deps
