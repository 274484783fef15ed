"""Risk rules over a plan: each is a filter or a join that names what it found and why, and their union is the list of escalations."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the rules and severities.
OVERDUE, TICKET_OVERDUE, DEPENDENCY_SLIP, PROJECTED_LATE, UNOWNED = (
    "milestone_overdue", "blocking_ticket_overdue", "dependency_slip", "projected_late", "unowned_milestone",
)
SEVERITIES = ("high", "medium", "low")
ESCALATION_KEY = ["as_of", "milestone_key", "rule_id", "subject_key"]


@dataclass(frozen=True)
class RuleConfig:
    """A parent's slip must exceed the tolerance; a milestone without an owner counts if it is due within so many days."""

    slip_tolerance_days: int = 3
    unowned_within_days: int = 7


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def evaluate(plan: DataFrame, deps: DataFrame, tickets: DataFrame, as_of: date, config: RuleConfig | None = None) -> DataFrame:
    """rank, rule_id, severity, milestone_key, subject_key, detail of each risk of an open milestone.

    Order by rank, milestone_key, rule_id and subject_key to read them. tickets: ticket_key, milestone_key, status,
    is_open, due_date (date; without one a ticket is never overdue).
    """
    config, today = config or RuleConfig(), F.lit(as_of).cast("date")
    text = lambda c: c.cast("string")
    still = plan.filter("not is_done")

    def found(rows: DataFrame, rule: str, severity: str, detail: list[Column | str], subject: Column | None = None) -> DataFrame:
        parts = [F.lit(p) if isinstance(p, str) else p for p in detail]
        return rows.select(
            F.lit(SEVERITIES.index(severity)).alias("rank"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "milestone_key",
            (F.lit("") if subject is None else subject).alias("subject_key"), F.concat(*parts).alias("detail"),
        )

    slip, days_out = F.col("slip_days"), F.date_diff(F.col("planned_end"), today)
    late = tickets.filter(F.col("is_open") & (F.col("due_date") < today)).select("ticket_key", "milestone_key", F.col("status").alias("ticket_status"), "due_date")
    slipped = plan.filter(slip > config.slip_tolerance_days).select(F.col("milestone_key").alias("depends_on_key"), slip.alias("parent_slip"))
    parents = deps.select("milestone_key", "depends_on_key").distinct().join(slipped, "depends_on_key")
    keys = still.select("milestone_key")
    return (
        found(still.filter("is_overdue"), OVERDUE, "high", ["planned ", _iso(F.col("planned_end")), f", still open on {as_of.isoformat()} (", text(slip), "d late)"])
        .unionByName(found(
            keys.join(late, "milestone_key"), TICKET_OVERDUE, "high",
            ["ticket ", F.col("ticket_key"), " is ", F.col("ticket_status"), " and was due ", _iso(F.col("due_date")), " (", text(F.date_diff(today, F.col("due_date"))), "d ago)"],
            F.col("ticket_key"),
        ))
        .unionByName(found(
            keys.join(parents, "milestone_key"), DEPENDENCY_SLIP, "high",
            ["depends on ", F.col("depends_on_key"), ", which has slipped ", text(F.col("parent_slip")), f"d (tolerance {config.slip_tolerance_days}d)"],
            F.col("depends_on_key"),
        ))
        .unionByName(found(
            still.filter("not is_overdue and projected_end > planned_end"), PROJECTED_LATE, "medium",
            ["planned ", _iso(F.col("planned_end")), ", projected ", _iso(F.col("projected_end")), " (", text(F.col("inherited_slip_days")), "d inherited from upstream)"],
        ))
        .unionByName(found(
            still.filter((F.coalesce("owner_email", F.lit("")) == "") & days_out.between(0, config.unowned_within_days)), UNOWNED, "low",
            ["due in ", text(days_out), "d with no owner assigned"],
        ))
    )


def record(old: DataFrame, found: DataFrame, as_of: date, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The table of escalations with those that were not yet recorded for the date, and these new ones."""
    rows = found.select(
        F.lit(as_of).cast("date").alias("as_of"), "milestone_key", "rule_id", "severity", "subject_key", "detail", F.lit(now).cast("timestamp").alias("created_at")
    ).dropDuplicates(ESCALATION_KEY)
    new = rows.join(old.select(*ESCALATION_KEY), ESCALATION_KEY, "left_anti").select(*old.columns)
    return old.unionByName(new), new
