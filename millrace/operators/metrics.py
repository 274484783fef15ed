"""What the store's tables say about the sync: funnel, throughput, writes over time, the dead-letter queue, lags, deals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import age_band, age_hours, bucket_start, exact_amount, hours_text, money_text, one_decimal
from millrace.model import CONFLICT, CREATED, EXHAUSTED, KEY, POISON, SCHEMA_DRIFT, UPDATED

#: Depth and age in hours from which the queue is an incident.
ALERT_DEPTH, ALERT_HOURS = 5, 24.0


def _time(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp")


def funnel(ledger: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: ingested, validated, upserted, dead_lettered_open, failed_validation, failed_write, upsert_rate.

    A dead letter whose key has since reached the ledger has recovered; it counts as open as long as it is unresolved.
    """
    none = F.lit(None).cast("string")
    both = ledger.select(*KEY, F.lit(True).alias("held"), none.alias("category"), F.lit(False).alias("open")).unionByName(
        dead.select(*KEY, F.lit(False).alias("held"), "category", (~F.col("resolved")).alias("open"))
    )
    per_key = both.groupBy(*KEY).agg(F.max("held").alias("held"), F.max("category").alias("category"), F.max("open").alias("open"))
    lost = ~F.col("held")
    counts = per_key.agg(
        F.count("*").alias("ingested"),
        F.count_if("held").alias("upserted"),
        F.count_if("open").alias("dead_lettered_open"),
        F.count_if(lost & F.col("category").startswith(POISON)).alias("failed_validation"),
        F.count_if(lost & (F.col("category") == EXHAUSTED)).alias("failed_write"),
    )
    return counts.select(
        "ingested", (F.col("ingested") - F.col("failed_validation")).alias("validated"), "upserted", "dead_lettered_open",
        "failed_validation", "failed_write", F.expr("try_divide(upserted, ingested)").alias("upsert_rate"),
    )


def funnel_stages(counts: DataFrame) -> DataFrame:
    """pos, stage, records and the change from the stage before (none for the first and for the queue)."""
    names = ("ingested", "validated", "upserted", "dead_lettered_open")
    labels = (*names[:3], "dead-lettered (open)")
    rows = []
    for i, (name, label) in enumerate(zip(names, labels, strict=True)):
        change = F.col(name) - F.col(names[i - 1]) if i in (1, 2) else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i).alias("pos"), F.lit(label).alias("stage"), F.col(name).alias("records"), change.alias("change")))
    return counts.select(F.inline(F.array(*rows)))


def throughput_by_source(ledger: DataFrame, dead: DataFrame, cursors: DataFrame, audit: DataFrame, as_of: datetime) -> DataFrame:
    """One row per source that was ever seen: records, counts of audited actions, open dead letters, and the last write and its age."""
    action = lambda name: F.count_if(F.col("action") == name)
    wrote = F.col("action").isin(CREATED, UPDATED)
    known = ledger.select("source").unionByName(dead.select("source")).unionByName(cursors.select("source")).distinct()
    audited = audit.groupBy("source").agg(
        action(CREATED).alias("created"), action(UPDATED).alias("updated"), action(CONFLICT).alias("conflicts"),
        action(SCHEMA_DRIFT).alias("drift_notes"), F.max(F.when(wrote, F.col("at"))).alias("last_write_at"),
    )
    counts = {"records": ledger.groupBy("source").agg(F.count("*").alias("records"))}
    counts["dead_lettered_open"] = dead.groupBy("source").agg(F.count_if(~F.col("resolved")).alias("dead_lettered_open"))
    out = known.join(audited, "source", "left")
    for part in counts.values():
        out = out.join(part, "source", "left")
    numbers = ["records", "created", "updated", "conflicts", "drift_notes", "dead_lettered_open"]
    return out.fillna(0, numbers).select("source", *numbers, "last_write_at", age_hours(F.col("last_write_at"), _time(as_of)).alias("last_write_age_hours"))


def bucket_range(lo: Column, hi: Column, bucket: str = "hour") -> Column:
    """Every bucket from lo's to hi's, as an array; empty if the bounds are inverted or null."""
    step = F.expr(f"interval 1 {bucket}")
    none = F.array().cast("array<timestamp>")
    return F.when(lo <= hi, F.sequence(bucket_start(lo, bucket), bucket_start(hi, bucket), step)).otherwise(none)


def writes_over_time(audit: DataFrame, bucket: str = "hour", fill_gaps: bool = True) -> DataFrame:
    """bucket, source, created, updated: records that landed. With fill_gaps, each source has a row for every bucket of the whole span."""
    writes = audit.filter(F.col("action").isin(CREATED, UPDATED) & F.col("at").isNotNull())
    counts = writes.groupBy(bucket_start(F.col("at"), bucket).alias("bucket"), "source").agg(
        F.count_if(F.col("action") == CREATED).alias("created"), F.count_if(F.col("action") == UPDATED).alias("updated")
    )
    if not fill_gaps:
        return counts
    span = writes.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    grid = counts.select("source").distinct().crossJoin(F.broadcast(span))  # one row
    grid = grid.select("source", F.explode(bucket_range(F.col("lo"), F.col("hi"), bucket)).alias("bucket"))
    return grid.join(counts, ["bucket", "source"], "left").fillna(0, ["created", "updated"]).select("bucket", "source", "created", "updated")


def writes_pivot(series: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """A row per bucket and a column per source, of created and updated together; zero where there is none.

    Without the sources Spark looks them up, and refuses more than spark.sql.pivotMaxValues of them.
    """
    return series.groupBy("bucket").pivot("source", sources).agg(F.sum(F.col("created") + F.col("updated"))).fillna(0)


def dead_letter_rows(dead: DataFrame, as_of: datetime) -> DataFrame:
    """The open queue with age and band; order by age_hours descending, source and key to read it oldest first."""
    hours = age_hours(F.col("first_seen_at"), _time(as_of))
    return dead.filter("not resolved").select(
        *KEY, "category", "error", "failure_count", "first_seen_at", hours.alias("age_hours"), age_band(hours).alias("band")
    )


def dead_letter_summary(dead: DataFrame, as_of: datetime) -> DataFrame:
    """One row: depth, oldest_hours, and whether that is an incident."""
    found = dead_letter_rows(dead, as_of).agg(F.count("*").alias("depth"), F.max("age_hours").alias("oldest_hours"))
    return found.withColumn("alert", (F.col("depth") >= ALERT_DEPTH) | (F.coalesce("oldest_hours", F.lit(0.0)) >= ALERT_HOURS))


def dead_letters_by(dead: DataFrame, as_of: datetime, by: str) -> DataFrame:
    """Open dead letters by band, source or category."""
    return dead_letter_rows(dead, as_of).groupBy(by).agg(F.count("*").alias("n"))


def cursor_lag(cursors: DataFrame, as_of: datetime) -> DataFrame:
    """How far each source's data is behind (lag_hours), and how long its cursor was not touched (staleness_hours); null for no cursor."""
    return cursors.select(
        "source", "cursor", "updated_at",
        age_hours(F.col("cursor"), _time(as_of)).alias("lag_hours"), age_hours(F.col("updated_at"), _time(as_of)).alias("staleness_hours"),
    )


def deals_by_stage(deals: DataFrame) -> DataFrame:
    """Deals and the exact sum of their amounts as text, per stage; an empty stage is ``unset``, an amount that is no number counts as zero."""
    stage = F.coalesce(F.nullif("stage", F.lit("")), F.lit("unset"))
    return deals.groupBy(stage.alias("stage")).agg(F.count("*").alias("deals"), money_text(F.sum(exact_amount(F.col("amount")))).alias("amount"))


def ticket_counts(tickets: DataFrame) -> DataFrame:
    """Open and all tickets of each milestone."""
    named = tickets.filter(F.coalesce("milestone_key", F.lit("")) != "")
    return named.groupBy("milestone_key").agg(F.count_if("is_open").alias("open"), F.count("*").alias("total"))


def snapshot_counts(state: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name in sorted(state):
        part = state[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def health(ledger: DataFrame, activities: DataFrame) -> DataFrame:
    """One row: keys of the ledger and of the activities, how many stand in one only, and whether all agree."""
    both = ledger.select(*KEY, F.lit(1).alias("l"), F.lit(0).alias("a")).unionByName(activities.select(*KEY, F.lit(0).alias("l"), F.lit(1).alias("a")))
    per_key = both.groupBy(*KEY).agg(F.sum("l").alias("l"), F.sum("a").alias("a"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("ledger"), F.coalesce(F.sum("a"), F.lit(0)).alias("activities"),
        F.count_if(F.col("l") != F.col("a")).alias("apart"), (F.count_if(F.col("l") != F.col("a")) == 0).alias("healthy"),
    )


#: The panels of the dashboard.
PANELS = ("tiles", "cursors", "writes", "throughput", "funnel", "queue", "deals")


def dashboard(state: dict[str, DataFrame], deals: DataFrame, as_of: datetime, *panels: str) -> dict[str, DataFrame]:
    """The named panels, or all, each a table that is ready to show. What is not asked for costs nothing."""
    ledger, dead, audit = state["ledger"], state["dead_letter"], state["audit"]

    def tiles() -> DataFrame:
        rate = F.coalesce(F.concat(one_decimal(F.col("upsert_rate") * 100), F.lit("%")), F.lit("n/a"))
        both = funnel(ledger, dead).crossJoin(F.broadcast(dead_letter_summary(dead, as_of)))  # one row each
        return both.select(F.col("upserted").alias("records"), "depth", hours_text(F.col("oldest_hours")).alias("oldest"), rate.alias("upsert_rate"), "alert")

    def cursors() -> DataFrame:
        shown = F.coalesce(F.date_format("cursor", "yyyy-MM-dd HH:mm:ss"), F.lit("never set")).alias("cursor")
        lag = cursor_lag(state["cursors"], as_of)
        return lag.select("source", shown, hours_text(F.col("lag_hours")).alias("data_lag"), hours_text(F.col("staleness_hours")).alias("job_staleness"))

    def throughput() -> DataFrame:
        ago = F.when(F.col("last_write_age_hours").isNull(), "never").otherwise(F.concat(hours_text(F.col("last_write_age_hours")), F.lit(" ago")))
        return throughput_by_source(ledger, dead, state["cursors"], audit, as_of).withColumn("last_write", ago).drop("last_write_at", "last_write_age_hours")

    made = {
        "tiles": tiles, "cursors": cursors, "writes": lambda: writes_pivot(writes_over_time(audit)), "throughput": throughput, "funnel": lambda: funnel_stages(funnel(ledger, dead)),
        "queue": lambda: dead_letter_rows(dead, as_of).withColumn("age", hours_text(F.col("age_hours"))), "deals": lambda: deals_by_stage(deals),
    }
    return {name: made[name]() for name in panels or PANELS}
