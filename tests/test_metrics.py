from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.model import TABLES
from millrace.operators import metrics

AS_OF = datetime(2026, 1, 10)


def make(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


def ledger(spark, *keys):
    return make(spark, "ledger", [("s", k, "h", AS_OF, 1, AS_OF, AS_OF) for k in keys])


def dead(spark, *rows):
    return make(spark, "dead_letter", [(s, k, "{}", "e", c, 1, seen, AS_OF, done) for s, k, c, seen, done in rows])


def audit(spark, *rows):
    return make(spark, "audit", [(at, s, "k", action, None, None, "") for at, s, action in rows])


def test_a_recovered_record_is_not_lost_but_its_entry_stays_open(spark):
    queue = dead(spark, ("s", "a", "poison", AS_OF, False), ("s", "b", "poison_no_key", AS_OF, False), ("s", "c", "transient_exhausted", AS_OF, False), ("s", "d", "transient_exhausted", AS_OF, True))
    r = metrics.funnel(ledger(spark, "a", "d", "e"), queue).first()
    assert (r["ingested"], r["validated"], r["upserted"], r["dead_lettered_open"], r["failed_validation"], r["failed_write"]) == (5, 4, 3, 3, 1, 1)
    assert r["upsert_rate"] == 0.6
    assert metrics.funnel(ledger(spark), dead(spark)).first()["upsert_rate"] is None


def test_gaps_are_filled(spark):
    log = audit(
        spark, (datetime(2026, 1, 1, 9, 30), "a", "created"), (datetime(2026, 1, 1, 9, 59), "a", "updated"), (datetime(2026, 1, 1, 12), "b", "created"),
        (datetime(2026, 1, 1, 10), "a", "conflict_ignored"), (None, "a", "created"),
    )
    rows = {(r["bucket"].hour, r["source"]): (r["created"], r["updated"]) for r in metrics.writes_over_time(log).collect()}
    assert len(rows) == 8 and rows[9, "a"] == (1, 1) and rows[12, "b"] == (1, 0) and rows[10, "a"] == (0, 0)
    assert metrics.writes_over_time(log, fill_gaps=False).count() == 2
    assert metrics.writes_over_time(log, "day").count() == 2
    assert metrics.writes_over_time(audit(spark)).isEmpty()
    wide = {r["bucket"].hour: (r["a"], r["b"]) for r in metrics.writes_pivot(metrics.writes_over_time(log)).collect()}
    assert wide[9] == (2, 0) and wide[12] == (0, 1)
    empty = spark.range(1).select(F.size(metrics.bucket_range(F.lit(datetime(2026, 1, 2)), F.lit(datetime(2026, 1, 1)))).alias("n"))
    assert empty.first()["n"] == 0


def test_throughput_has_every_source_that_was_seen(spark):
    cursors = make(spark, "cursors", [("quiet", None, AS_OF)])
    log = audit(spark, (datetime(2026, 1, 9), "s", "created"), (datetime(2026, 1, 9, 12), "s", "schema_drift"), (AS_OF, "s", "conflict_ignored"))
    found = metrics.throughput_by_source(ledger(spark, "a", "b"), dead(spark, ("d", "x", "poison", AS_OF, False), ("d", "y", "poison", AS_OF, True)), cursors, log, AS_OF)
    rows = {r["source"]: r for r in found.collect()}
    assert set(rows) == {"s", "d", "quiet"}
    s = rows["s"]
    assert (s["records"], s["created"], s["updated"], s["conflicts"], s["drift_notes"], s["dead_lettered_open"], s["last_write_age_hours"]) == (2, 1, 0, 1, 1, 0, 24.0)
    assert rows["d"]["dead_lettered_open"] == 1 and rows["quiet"]["last_write_age_hours"] is None


def test_queue_report(spark):
    queue = dead(spark, ("s", "a", "poison", datetime(2026, 1, 9), False), ("s", "b", "poison", datetime(2026, 1, 9, 23, 30), False), ("t", "c", "poison", datetime(2026, 1, 1), False), ("t", "d", "poison", datetime(2025, 1, 1), True))
    by_band = {r["band"]: r["n"] for r in metrics.dead_letters_by(queue, AS_OF, "band").collect()}
    assert by_band == {"1d to 7d": 1, "under 1h": 1, "over 7d": 1}
    r = metrics.dead_letter_summary(queue, AS_OF).first()
    assert (r["depth"], r["oldest_hours"], r["alert"]) == (3, 216.0, True)
    r = metrics.dead_letter_summary(dead(spark), AS_OF).first()
    assert (r["depth"], r["oldest_hours"], r["alert"]) == (0, None, False)


def test_lag_is_of_the_data_and_staleness_of_the_job(spark):
    cursors = make(spark, "cursors", [("a", datetime(2026, 1, 7), datetime(2026, 1, 10)), ("b", None, datetime(2026, 1, 8)), ("c", datetime(2027, 1, 1), AS_OF)])
    rows = {r["source"]: (r["lag_hours"], r["staleness_hours"]) for r in metrics.cursor_lag(cursors, AS_OF).collect()}
    assert rows == {"a": (72.0, 0.0), "b": (None, 48.0), "c": (0.0, 0.0)}


def test_deals_are_summed_exactly(spark):
    deals = spark.createDataFrame([("won", "0.10"), ("won", "0.20"), ("", "x"), (None, "1e2"), ("big", "90000000000000000.01")], "stage string, amount string")
    assert {r["stage"]: (r["deals"], r["amount"]) for r in metrics.deals_by_stage(deals).collect()} == {"won": (2, "0.30"), "unset": (2, "100.00"), "big": (1, "90000000000000000.01")}


def test_health_and_counts(spark):
    activities = make(spark, "activities", [("s", "a", "e", "n", "k", "", "", AS_OF, AS_OF, "h", {})])
    r = metrics.health(ledger(spark, "a", "b"), activities).first()
    assert (r["ledger"], r["activities"], r["apart"], r["healthy"]) == (2, 1, 1, False)
    assert {r["table"]: r["n"] for r in metrics.snapshot_counts({"ledger": ledger(spark, "a"), "activities": activities}).collect()} == {"activities": 1, "ledger": 1}


def test_panels(spark):
    state = {n: make(spark, n, []) for n in TABLES}
    panels = metrics.dashboard(state, spark.createDataFrame([], "stage string, amount string"), AS_OF)
    assert panels["tiles"].first().asDict() == {"records": 0, "depth": 0, "oldest": "unknown", "upsert_rate": "n/a", "alert": False}
    assert panels["queue"].isEmpty() and panels["funnel"].count() == 4
