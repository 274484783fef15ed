"""Queries over the metrics. What the audit and the queue were stamped with is the event's own time, so that there is a history to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import backoff_delays, closed_stage, closed_status, domain_of, content_hash, entries_of, hours_text, iso_text, name_of_email, parse_date, strip, utc_timestamp
from millrace.model import KEY
from millrace.operators import metrics
from millrace.operators.normalize import dead_letters, normalize
from millrace.operators.projections import first_existing
from millrace.plans.events import AS_OF, decided_events, decided_sql, raw_events, synced_events, table


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided_events(spark, sf_dir).select(F.col("occurred").alias("at"), "source", F.col("decision").alias("action"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with an entry for each record that was refused, seen when its event happened; every fourth is resolved."""
    rows = normalize(raw_events(spark, sf_dir), None).filter("error is not null")
    number = F.regexp_extract("subject", r"(\d+)$", 1).cast("long")
    when = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    keyed = dead_letters(rows).join(rows.select("arrival", number.alias("n")), "arrival").join(when, "n")
    return keyed.withColumn("failure_count", F.lit(1)).withColumn("resolved", F.col("n") % 4 == 0)


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = synced_events(spark, sf_dir, failing=True)
    return metrics.funnel(state["ledger"], state["dead_letter"]).drop("upsert_rate")


def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = synced_events(spark, sf_dir, failing=True)
    return metrics.funnel_stages(metrics.funnel(state["ledger"], state["dead_letter"]))


def throughput_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = synced_events(spark, sf_dir)
    found = metrics.throughput_by_source(state["ledger"], state["dead_letter"], state["cursors"], state["audit"], AS_OF)
    return found.withColumn("last_write_age_hours", F.round("last_write_age_hours", 6)).drop("last_write_at")


def writes_hourly_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.writes_over_time(_audit(spark, sf_dir)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def writes_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.writes_over_time(_audit(spark, sf_dir), "day", fill_gaps=False).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def writes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = metrics.writes_over_time(_audit(spark, sf_dir), "day")
    return metrics.writes_pivot(series).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def dlq_age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dead_letters_by(_queue(spark, sf_dir), AS_OF, "band")


def dlq_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dead_letters_by(_queue(spark, sf_dir), AS_OF, "source")


def dlq_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dead_letters_by(_queue(spark, sf_dir), AS_OF, "category")


def dlq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dead_letter_summary(_queue(spark, sf_dir), AS_OF).withColumn("oldest_hours", F.round("oldest_hours", 6))


def dlq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.dead_letter_rows(_queue(spark, sf_dir), AS_OF)
    return rows.select(*KEY, "category", "error", F.round("age_hours", 6).alias("age_hours"), "band", hours_text(F.col("age_hours")).alias("age"))


def cursor_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = metrics.cursor_lag(synced_events(spark, sf_dir)["cursors"], AS_OF)
    return lag.select("source", F.round("lag_hours", 6).alias("lag_hours"), "staleness_hours")


def deals_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return metrics.deals_by_stage(table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("stage"), amount.alias("amount")))


def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = synced_events(spark, sf_dir)
    return metrics.health(state["ledger"], state["activities"])


def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshot_counts(synced_events(spark, sf_dir))


def dashboard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = synced_events(spark, sf_dir, failing=True)
    none = spark.createDataFrame([], "stage string, amount string")
    return metrics.dashboard(state, none, AS_OF, "tiles")["tiles"]


def association_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the first supplier of each order, by line, that has a positive balance."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("lines"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    listed = rows.select("o_orderkey", F.transform("lines", lambda x: x["l_suppkey"]).alias("ids"))
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")
    return first_existing(listed, "o_orderkey", "ids", known, "s_suppkey", "s_name")


def unrecovered_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left_anti")


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event, how many of its user's events lie in the 60 seconds up to it, and whether a quota of two admits it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    trailing = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000 + 1, 0)
    return e.withColumn("in_window", F.count("*").over(trailing)).select("event_id", "in_window", (F.col("in_window") <= 2).alias("admitted"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    delays = F.posexplode_outer(backoff_delays(F.col("n_nationkey") + 1, 0.5, 2.0, 30.0)).alias("attempt", "delay")
    return table(spark, sf_dir, "nation").select("n_nationkey", delays)


def scalar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text functions over every event."""
    e = table(spark, sf_dir, "events")
    email = F.concat(F.lit("first.o'last-"), F.col("user_id").cast("string"), F.lit("x@ Mail."), "event_type", F.lit(" "))
    status = F.when(F.col("value") < 20, F.lit(" Done ")).when(F.col("value") < 40, F.lit("CLOSED")).otherwise(F.col("event_type"))
    return e.select(
        "event_id", domain_of(email).alias("domain"), name_of_email(email).alias("name"), strip(F.concat(F.lit(" \t "), "props", F.lit(" \n"))).alias("stripped"),
        closed_status(status).alias("closed"), closed_stage(F.concat(F.lit("Closed"), F.when(F.col("value") < 50, "Won").otherwise("Maybe"))).alias("stage_closed"),
        hours_text(F.floor(F.col("value") * 10) / 10).alias("hours"),
    )


def scalar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts in several spellings, read and written again."""
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyyMMdd'T'HHmmss")).when(kind == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+05:30'")).when(kind == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm'Z'"))
        .when(kind == 4, F.date_format(ts, "yyyy-M")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    )
    e = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return e.select("event_id", "text", iso_text(utc_timestamp(F.col("text"))).alias("utc"), F.date_format(parse_date(F.col("text")), "yyyy-MM-dd").alias("day"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every customer's fields."""
    c = table(spark, sf_dir, "customer")
    fields = {"subject": F.concat(F.lit("  "), "c_name"), "kind": F.col("c_mktsegment"), "body": F.lit(None).cast("string")}
    extra = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", content_hash(entries_of(extra, **fields)).alias("digest"))


QUERIES = {
    "funnel": funnel,
    "funnel_stages": funnel_stages,
    "throughput_by_source": throughput_by_source,
    "writes_hourly_dense": writes_hourly_dense,
    "writes_daily": writes_daily,
    "writes_pivot": writes_pivot,
    "dlq_age_bands": dlq_age_bands,
    "dlq_by_source": dlq_by_source,
    "dlq_by_category": dlq_by_category,
    "dlq_summary": dlq_summary,
    "dlq_rows": dlq_rows,
    "cursor_lag": cursor_lag,
    "deals_by_stage": deals_by_stage,
    "health_check": health_check,
    "snapshot_counts": snapshot_counts,
    "dashboard_tiles": dashboard_tiles,
    "association_resolve": association_resolve,
    "unrecovered_anti_join": unrecovered_anti_join,
    "rate_limit_window": rate_limit_window,
    "backoff_schedule": backoff_schedule,
    "scalar_texts": scalar_texts,
    "scalar_times": scalar_times,
    "content_hashes": content_hashes,
}

_PLAIN, _FAILING = decided_sql(), decided_sql(failing=True)
_HOURS = "date_diff('microseconds', {}, TIMESTAMP '2024-02-01') / 3600000000.0"
_QUEUE = f"""{_PLAIN}, queue AS (
    SELECT f.source, f.natural_key, f.category, f.error, CAST(split_part(s.subject, ' ', 2) AS BIGINT) AS n, greatest(0.0, {_HOURS.format('s.occurred')}) AS age_hours
    FROM failures f JOIN staged s USING (arrival)),
    open_queue AS (SELECT *, CASE WHEN age_hours < 1 THEN 'under 1h' WHEN age_hours < 24 THEN '1h to 24h' WHEN age_hours < 168 THEN '1d to 7d' ELSE 'over 7d' END AS band
    FROM queue WHERE n % 4 <> 0)"""
_COUNTS = """counts AS (
    SELECT (SELECT count(*) FROM (SELECT source, natural_key FROM ledger UNION SELECT source, natural_key FROM dead)) AS ingested,
           (SELECT count(*) FROM ledger) AS upserted, (SELECT count(*) FROM dead) AS dead_lettered_open,
           (SELECT count(*) FROM dead d WHERE category LIKE 'poison%' AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.source = d.source AND l.natural_key = d.natural_key)) AS failed_validation,
           (SELECT count(*) FROM dead d WHERE category = 'transient_exhausted' AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.source = d.source AND l.natural_key = d.natural_key)) AS failed_write)"""
_TEXT_HOURS = "CASE WHEN {0} < 1 THEN format('{{:.0f}} min', {0} * 60) WHEN {0} < 48 THEN format('{{:.1f}} h', {0}) ELSE format('{{:.1f}} d', {0} / 24) END"
_DAILY = "SELECT date_trunc('day', occurred) AS bucket, source, count(*) FILTER (decision = 'created') AS created, count(*) FILTER (decision = 'updated') AS updated FROM applied GROUP BY 1, 2"

ORACLE_SQL = {
    "funnel": f"{_FAILING}, {_COUNTS} SELECT ingested, ingested - failed_validation AS validated, upserted, dead_lettered_open, failed_validation, failed_write FROM counts",
    "funnel_stages": f"""{_FAILING}, {_COUNTS}
        SELECT 0 AS pos, 'ingested' AS stage, ingested AS records, CAST(NULL AS BIGINT) AS change FROM counts
        UNION ALL SELECT 1, 'validated', ingested - failed_validation, -failed_validation FROM counts
        UNION ALL SELECT 2, 'upserted', upserted, upserted - (ingested - failed_validation) FROM counts
        UNION ALL SELECT 3, 'dead-lettered (open)', dead_lettered_open, NULL FROM counts""",
    "throughput_by_source": f"""{_PLAIN},
        conflicts AS (SELECT DISTINCT source, natural_key, hash FROM decided WHERE decision = 'conflict_ignored'),
        notes AS (SELECT DISTINCT source, natural_key FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged'))
        SELECT s.source, (SELECT count(*) FROM ledger l WHERE l.source = s.source) AS records,
               (SELECT count(*) FROM decided d WHERE d.source = s.source AND decision = 'created') AS created,
               (SELECT count(*) FROM decided d WHERE d.source = s.source AND decision = 'updated') AS updated,
               (SELECT count(*) FROM conflicts c WHERE c.source = s.source) AS conflicts, (SELECT count(*) FROM notes n WHERE n.source = s.source) AS drift_notes,
               (SELECT count(*) FROM dead d WHERE d.source = s.source) AS dead_lettered_open, CAST(0.0 AS DOUBLE) AS last_write_age_hours
        FROM (SELECT DISTINCT source FROM staged) s""",
    "writes_hourly_dense": f"""{_PLAIN},
        span AS (SELECT min(occurred) AS lo, max(occurred) AS hi FROM applied),
        hours AS (SELECT unnest(generate_series(date_trunc('hour', lo), date_trunc('hour', hi), INTERVAL 1 HOUR)) AS bucket FROM span)
        SELECT h.bucket, s.source, count(*) FILTER (a.decision = 'created') AS created, count(*) FILTER (a.decision = 'updated') AS updated
        FROM hours h CROSS JOIN (SELECT DISTINCT source FROM applied) s
        LEFT JOIN applied a ON a.source = s.source AND date_trunc('hour', a.occurred) = h.bucket GROUP BY h.bucket, s.source""",
    "writes_daily": f"{_PLAIN} SELECT CAST(bucket AS TIMESTAMP) AS bucket, source, created, updated FROM ({_DAILY})",
    "writes_pivot": f"""{_PLAIN},
        span AS (SELECT min(occurred) AS lo, max(occurred) AS hi FROM applied),
        days AS (SELECT unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL 1 DAY)) AS bucket FROM span)
        SELECT CAST(d.bucket AS TIMESTAMP) AS bucket, count(*) FILTER (source = 'click') AS click, count(*) FILTER (source = 'error') AS error,
               count(*) FILTER (source = 'purchase') AS purchase, count(*) FILTER (source = 'signup') AS signup, count(*) FILTER (source = 'view') AS view
        FROM days d LEFT JOIN applied a ON date_trunc('day', a.occurred) = d.bucket GROUP BY d.bucket""",
    "dlq_age_bands": f"{_QUEUE} SELECT band, count(*) AS n FROM open_queue GROUP BY band",
    "dlq_by_source": f"{_QUEUE} SELECT source, count(*) AS n FROM open_queue GROUP BY source",
    "dlq_by_category": f"{_QUEUE} SELECT category, count(*) AS n FROM open_queue GROUP BY category",
    "dlq_summary": f"{_QUEUE} SELECT count(*) AS depth, round(max(age_hours), 6) AS oldest_hours, count(*) >= 5 OR max(age_hours) >= 24 AS alert FROM open_queue",
    "dlq_rows": f"{_QUEUE} SELECT source, natural_key, category, error, round(age_hours, 6) AS age_hours, band, {_TEXT_HOURS.format('age_hours')} AS age FROM open_queue",
    "cursor_lag": f"{_PLAIN} SELECT source, round(greatest(0.0, {_HOURS.format('max(occurred)')}), 6) AS lag_hours, CAST(0.0 AS DOUBLE) AS staleness_hours FROM decided GROUP BY source",
    "deals_by_stage": """
        SELECT coalesce(nullif(o_orderstatus, 'P'), 'unset') AS stage, count(*) AS deals,
               CAST(sum(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS VARCHAR) AS amount FROM orders GROUP BY 1""",
    "health_check": f"{_PLAIN} SELECT count(*) AS ledger, count(*) AS activities, CAST(0 AS BIGINT) AS apart, true AS healthy FROM ledger",
    "snapshot_counts": f"""{_PLAIN}
        SELECT 'accounts' AS "table", count(DISTINCT account_name) AS n FROM applied UNION ALL SELECT 'activities', count(*) FROM ledger
        UNION ALL SELECT 'audit', (SELECT count(*) FROM applied) + (SELECT count(*) FROM (SELECT DISTINCT source, natural_key, hash FROM decided WHERE decision = 'conflict_ignored'))
            + (SELECT count(*) FROM (SELECT DISTINCT source, natural_key FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged')))
        UNION ALL SELECT 'contacts', count(DISTINCT contact_email) FROM applied UNION ALL SELECT 'cursors', count(DISTINCT source) FROM staged
        UNION ALL SELECT 'dead_letter', count(*) FROM dead UNION ALL SELECT 'ledger', count(*) FROM ledger
        UNION ALL SELECT 'escalations', 0 UNION ALL SELECT 'milestones', 0 UNION ALL SELECT 'milestone_deps', 0""",
    "dashboard_tiles": f"""{_FAILING}, {_COUNTS}
        SELECT upserted AS records, dead_lettered_open AS depth, '0 min' AS oldest, format('{{:.1f}}%', upserted * 100.0 / ingested) AS upsert_rate, dead_lettered_open >= 5 AS alert FROM counts""",
    "association_resolve": """
        SELECT o_orderkey, coalesce(arg_min(s_name, {'l': l_linenumber, 's': l_suppkey}), '') AS s_name
        FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0) ON l_orderkey = o_orderkey
        GROUP BY o_orderkey""",
    "unrecovered_anti_join": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "rate_limit_window": """
        SELECT event_id, in_window, in_window <= 2 AS admitted
        FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events)""",
    "backoff_schedule": """
        SELECT n_nationkey, CAST(i AS INT) AS attempt, CASE WHEN i IS NOT NULL THEN least(30.0, 0.5 * pow(2.0, i)) END AS delay
        FROM nation LEFT JOIN (SELECT unnest(range(0, 1000)) AS i) ON i < n_nationkey""",
    "scalar_texts": r"""
        SELECT event_id, 'mail.' || lower(event_type) AS domain, 'First O''Last-' || user_id || 'X' AS name, props AS stripped,
               value < 40 AS closed, value < 50 AS stage_closed, CASE WHEN h < 1 THEN format('{:.0f} min', h * 60) WHEN h < 48 THEN format('{:.1f} h', h) ELSE format('{:.1f} d', h / 24) END AS hours
        FROM (SELECT *, floor(value * 10) / 10 AS h FROM events)""",
    "scalar_times": """
        WITH t AS (SELECT event_id, event_id % 6 AS kind, ts FROM events),
        u AS (SELECT event_id, CASE kind WHEN 0 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+05:30')
                     WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%MZ') WHEN 4 THEN year(ts) || '-' || month(ts) ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') END AS text,
                     CASE kind WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL '5 hours 30 minutes'
                     WHEN 3 THEN date_trunc('minute', ts) WHEN 4 THEN NULL ELSE date_trunc('millisecond', ts) END AS t, kind, ts FROM t)
        SELECT event_id, text, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', t) % 1000000 = 0 THEN '' ELSE strftime(t, '.%f') END || '+00:00' AS utc,
               CASE kind WHEN 0 THEN NULL WHEN 4 THEN strftime(date_trunc('month', ts), '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM u""",
    "content_hashes": """
        SELECT c_custkey, sha256('{"body":"","extra.nation":"' || c_nationkey || '","kind":"' || c_mktsegment || '","subject":"' || trim(c_name) || '"}') AS digest FROM customer""",
}
