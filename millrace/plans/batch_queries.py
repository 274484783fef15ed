"""Queries that start from a filled store, from a cursor, or from an endpoint, and reads whose order counts."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import iso_text, utc_timestamp
from millrace.lineage import cut, own_dir, pack, portion, portions
from millrace.model import KEY
from millrace.operators import bucketed, limits, lookup, metrics
from millrace.operators.merge import State, apply_batch, decide, empty_state
from millrace.operators.normalize import normalize
from millrace.operators.order import in_order, numbered
from millrace.operators.projections import contact_emails
from millrace.operators.store import Store
from millrace.plans.events import AS_OF, dealt, decided_sql, raw_events, synced_events, table
from millrace.sources.files import after_cursor, calendar_text, parse_calendar, read_calendar
from millrace.sources.paged import recording
from millrace.sources.readers import read_contacts, read_deals, read_tickets

#: Records that arrive before this make the first batch.
SPLIT, LATER = 500_000, AS_OF + timedelta(days=1)
SINCE = datetime(2024, 1, 15)


def _batches(spark: SparkSession, sf_dir: str, failing: bool = False) -> tuple[State, State, DataFrame]:
    """The tables after a first and after a second batch, and the counts of the second."""
    raw = raw_events(spark, sf_dir, failing)
    before, _ = apply_batch(empty_state(spark), raw.filter(F.col("arrival") < SPLIT), now=AS_OF, sources=None)
    after, counts = apply_batch(before, raw.filter(F.col("arrival") >= SPLIT), now=LATER, sources=None)
    return before, after, counts


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _filled(name: str, failing: bool = False, drop: tuple[str, ...] = ()):
    return lambda spark, sf_dir: _ntz(_batches(spark, sf_dir, failing)[1][name].drop(*drop))


def second_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_batches(spark, sf_dir, failing=True)[2])


def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the first batch as a bucketed table, the second batch decided and merged against it, and the table of that."""
    raw, name = raw_events(spark, sf_dir, failing=True), uuid.uuid4().hex
    before, _ = apply_batch(empty_state(spark), raw.filter(F.col("arrival") < SPLIT), now=AS_OF, sources=None)
    ledger = bucketed.save_ledger(before["ledger"], f"ledger_{name}_1")
    valid = cut(normalize(raw.filter(F.col("arrival") >= SPLIT), None).filter("error is null"))
    decided = cut(decide(valid, ledger))
    return _ntz(bucketed.save_ledger(bucketed.merged_ledger(ledger, decided, LATER), f"ledger_{name}_2"))


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a state that was written, as the footers of its files say."""
    folder = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    state, n = synced_events(spark, sf_dir), portions(2 * table(spark, sf_dir, "events").count())
    for name, df in state.items():
        pack(f"{folder}/{name}", *([portion(df, i, n, *KEY) for i in range(n)] if name == "audit" else [df]))  # only the audit has a row for almost every record
    return lookup.stored_counts(spark, {name: f"{folder}/{name}" for name in state})


def audit_of_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit says of every key that has a dead letter, from an audit that is stored by key."""
    _, after, _ = _batches(spark, sf_dir, failing=True)
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    lookup.save_by_key(after["audit"], path, "natural_key", "source")
    return _ntz(lookup.find_all(spark.read.parquet(path), after["dead_letter"], "natural_key", "source"))


def calendar_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar entries after a cursor; every tenth is a whole day, every tenth in a zone of its own, every tenth without a time."""
    e, kind = dealt(table(spark, sf_dir, "events")), F.col("event_id") % 10
    local, ts = F.col("ts").cast("timestamp") + F.expr("interval 2 hours"), F.col("ts").cast("timestamp")
    start = (
        F.when(kind == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(ts, "yyyyMMdd")))
        .when(kind == 1, F.concat(F.lit("DTSTART;TZID=Etc/GMT-2:"), F.date_format(local, "yyyyMMdd'T'HHmmss")))
        .when(kind == 2, F.lit("X-NOTHING:x")).otherwise(F.concat(F.lit("DTSTART:"), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")))
    )
    text = F.concat_ws("\r\n", F.lit(""), F.concat(F.lit("UID:ev-"), F.col("event_id").cast("string")), start, F.lit("SUMMARY:a folded"), F.lit(r"  line\, and more"), F.lit("END:VEVENT"))
    raw = after_cursor(parse_calendar(e.select(text.alias("value"))), SINCE)
    return raw.select("natural_key", "occurred_at", "subject")


def calendar_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of all events, written to files and read by its entries."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    entries = e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("uid"), F.col("event_type").alias("summary"), F.col("props").alias("description"), none.alias("location"),
        F.col("ts").cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.lit("a@b.example").alias("organizer_email"), none.alias("organizer_name"), none.alias("account_name"),
    )
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    calendar_text(entries).write.text(path)
    return read_calendar(spark, path).select("natural_key", "subject", "body", "contact_email")


def source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each record where only some sources are known and extra comes as JSON text."""
    number = F.regexp_extract("subject", r"(\d+)$", 1).cast("long") % 4
    extra = F.when(number == 0, '{"a":"1"}').when(number == 1, "[1]").when(number == 3, '"x"')
    rows = normalize(raw_events(spark, sf_dir).drop("extra").withColumns({"extra": F.lit(None).cast("map<string,string>"), "extra_json": extra}), ("click", "view", "error"))
    return rows.select("arrival", "error", F.to_json("extra").alias("extra"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event, whether a quota of two in six hours admits it, and else the wait that it is told; refused events take no quota."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    judged = limits.admitted(e, 2, 6 * 3_600_000_000, client="user_id", number="event_id")
    return judged.select("event_id", "user_id", F.col("wait_us").isNull().alias("admitted"), "wait_us")


def activities_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activities of one source in the order in which the table is read, with their places."""
    rows = in_order("activities", synced_events(spark, sf_dir)["activities"], source="view")
    return numbered(rows.select(*KEY, "contact_email"), *KEY)


def dead_letters_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open queue, oldest first."""
    queue = metrics.dead_letter_rows(_batches(spark, sf_dir, failing=True)[1]["dead_letter"], LATER + timedelta(hours=5))
    return numbered(queue.select(*KEY, "failure_count", "age_hours", "band"), F.desc("age_hours"), *KEY)


def week_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO week dates in both spellings, read as instants."""
    e, ts = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    day, week = F.weekday(ts) + 1, F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(year, F.lit("-W"), week, F.lit("-"), day.cast("string"))).otherwise(F.concat(year, F.lit("W"), week, day.cast("string")))
    return e.select("event_id", iso_text(utc_timestamp(text)).alias("utc"))


def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches committed to a store; rows of each table at each version, read back."""
    store, raw = Store(spark, f"{own_dir(spark)}/store-{uuid.uuid4().hex}"), raw_events(spark, sf_dir, failing=True)
    for batch, now in ((raw.filter(F.col("arrival") < SPLIT), AS_OF), (raw.filter(F.col("arrival") >= SPLIT), LATER)):
        store.merge(batch, now=now, sources=None)
    out = None
    for version in (1, 2):
        counts = metrics.snapshot_counts({k: v for k, v in store.read(version).items() if k in ("activities", "audit", "contacts", "dead_letter", "ledger")})
        counts = counts.withColumn("version", F.lit(version))
        out = counts if out is None else out.unionByName(counts)
    return out


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return sorted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())  # 25 rows


def endpoint_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tickets of a paged endpoint that refuses its second page once and renames fields from the third on, read after a cursor."""
    issue = lambda r: {"key": f"T-{r[0]}", "fields": {"summary": r[1], "status": "Done" if r[2] == 0 else "open", "updated": f"2024-01-{r[0] + 1:02d}T00:00:00Z", "assignee": {"emailAddress": f"n{r[0]}@x.example"}}}
    drift = lambda i: {"issueKey": i["key"], "fields": {"title": i["fields"]["summary"]} | {k: v for k, v in i["fields"].items() if k != "summary"}}
    exchanges = recording([issue(r) for r in _nations(spark, sf_dir)], "/search", page=4, drifts_from=2, drift=drift, refusals={1: 3.0})
    server = {"exchanges": json.dumps(exchanges), "waits": "false", "pageSize": "4", "tasks": "2"}
    raw = read_tickets(spark, server, datetime(2024, 1, 6))
    return raw.select("natural_key", "subject", "body", "contact_email", F.array_join(F.transform("drift", lambda n: n["field"]), ",").alias("drifted"))


def endpoint_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as contacts and as deals of two token-paged endpoints: contacts land first, and deals find the first of theirs that has."""
    rows = _nations(spark, sf_dir)

    def pages(path: str, objects: list[dict]) -> list[dict]:
        out = []
        for at in range(0, len(objects), 10):
            more = {"paging": {"next": {"after": str(at + 10)}}} if at + 10 < len(objects) else {}
            out.append({"path": path, "params": {"after": str(at)} if at else {}, "body": {"results": objects[at : at + 10]} | more})
        return sorted(out, key=lambda e: -len(e["params"]))  # a request is answered by the first that asks for nothing else

    changed = lambda k: f"2024-01-{k + 1:02d}T00:00:00Z"
    contacts = [{"id": str(k), "updatedAt": changed(k), "properties": {"email": f"n{k}@x.example" if k % 5 else None, "firstname": name}} for k, name, _ in rows]
    deals = [{"id": f"d{k}", "updatedAt": changed(k), "properties": {"dealname": name, "amount": "1"}, "associations": {"contacts": {"results": [{"id": str(k)}, {"id": str(k + 1)}]}}} for k, name, _ in rows]
    server = lambda path, objects: {"exchanges": json.dumps(pages(path, objects)), "waits": "false", "pageSize": "10"}
    people = read_contacts(spark, server("/crm/v3/objects/contacts", contacts), datetime(2024, 1, 3))
    state, _ = apply_batch(empty_state(spark), people, now=AS_OF)
    found = read_deals(spark, server("/crm/v3/objects/deals", deals), contact_emails(state["activities"]), datetime(2024, 1, 2))
    after, _ = apply_batch(state, found, now=AS_OF)
    return after["activities"].select("source", "natural_key", "contact_email", "subject", "body")


def _panel(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = synced_events(spark, sf_dir, failing=True)
        deals = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stage"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"))
        return _ntz(metrics.dashboard(state, deals, AS_OF, name)[name].drop("first_seen_at", "age_hours"))

    return query


QUERIES = {
    "filled_contacts": _filled("contacts"),
    "filled_accounts": _filled("accounts"),
    "filled_activities": _filled("activities", drop=("extra",)),
    "filled_ledger": _filled("ledger", failing=True),
    "filled_cursors": _filled("cursors"),
    "filled_dead_letters": _filled("dead_letter", failing=True, drop=("payload_json",)),
    "filled_audit": _filled("audit"),
    "second_batch_counts": second_batch_counts,
    "ledger_buckets": ledger_buckets,
    "stored_counts": stored_counts,
    "audit_of_dead_letters": audit_of_dead_letters,
    "calendar_since": calendar_since,
    "calendar_file": calendar_file,
    "source_check": source_check,
    "token_bucket": token_bucket,
    "activities_in_order": activities_in_order,
    "dead_letters_in_order": dead_letters_in_order,
    "week_dates": week_dates,
    "store_commits": store_commits,
    "endpoint_tickets": endpoint_tickets,
    "endpoint_crm": endpoint_crm,
    "panel_cursors": _panel("cursors"),
    "panel_writes": _panel("writes"),
    "panel_throughput": _panel("throughput"),
    "panel_funnel": _panel("funnel"),
    "panel_queue": _panel("queue"),
    "panel_deals": _panel("deals"),
}

_PLAIN, _FAILING = decided_sql(), decided_sql(failing=True)
_FIRST, _SECOND = "TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-02-02'"
_WHEN = f"CASE WHEN {{}} < {SPLIT} THEN {_FIRST} ELSE {_SECOND} END"
_TEXT_HOURS = "CASE WHEN {0} < 1 THEN format('{{:.0f}} min', {0} * 60) WHEN {0} < 48 THEN format('{{:.1f}} h', {0}) ELSE format('{{:.1f}} d', {0} / 24) END"
_AUDIT = f"""
    SELECT {_WHEN.format("arrival")} AS at, source, natural_key, decision AS action, prev.h AS old_hash, hash AS new_hash, 'version ' || version AS detail FROM applied
    UNION ALL SELECT {_WHEN.format("min(arrival)")}, source, natural_key, 'conflict_ignored', arg_min(prev.h, arrival), hash,
        'incoming occurred_at ' || any_value(iso) || ' older than stored; last-write-wins keeps stored' FROM decided WHERE decision = 'conflict_ignored' GROUP BY source, natural_key, hash
    UNION ALL SELECT {_WHEN.format("min(arrival)")}, source, natural_key, 'schema_drift', NULL, NULL, 'alias_used: value (arrived as ''val'', expected ''value'')'
        FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged') GROUP BY source, natural_key"""
_DEAD = f"""dead2 AS (SELECT source, natural_key, arg_max(error, arrival) AS error, arg_max(category, arrival) AS category, count(*) AS failure_count,
        {_WHEN.format("min(arrival)")} AS first_seen_at, {_WHEN.format("max(arrival)")} AS last_seen_at FROM failures GROUP BY source, natural_key)"""
_SNAPSHOT = """SELECT 'activities' AS "table", count(*) AS n FROM {ledger} UNION ALL SELECT 'ledger', count(*) FROM {ledger} UNION ALL SELECT 'contacts', count(DISTINCT contact_email) FROM {applied}
    UNION ALL SELECT 'dead_letter', count(*) FROM (SELECT DISTINCT source, natural_key FROM failures {where})
    UNION ALL SELECT 'audit', (SELECT count(*) FROM {applied}) + (SELECT count(*) FROM (SELECT DISTINCT source, natural_key, hash FROM decided WHERE decision = 'conflict_ignored' {also}))
        + (SELECT count(*) FROM (SELECT DISTINCT source, natural_key FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged') {also}))"""

from millrace.plans.metric_queries import ORACLE_SQL as _METRICS  # noqa: E402

ORACLE_SQL = {
    "panel_funnel": _METRICS["funnel_stages"],
    "filled_contacts": f"""{_PLAIN}
        SELECT contact_email AS email, coalesce(arg_max(contact_name, arrival) FILTER (contact_name <> ''), '') AS full_name, {_WHEN.format("min(arrival)")} AS created_at,
               coalesce({_WHEN.format("max(arrival) FILTER (contact_name <> '')").replace("CASE WHEN", "CASE WHEN max(arrival) FILTER (contact_name <> '') IS NULL THEN NULL WHEN")}, {_WHEN.format("min(arrival)")}) AS updated_at
        FROM applied GROUP BY contact_email""",
    "filled_accounts": f"""{_PLAIN}
        SELECT account_name AS name, arg_min(account_domain, arrival) AS domain, {_WHEN.format("min(arrival)")} AS created_at, {_WHEN.format("min(arrival)")} AS updated_at FROM applied GROUP BY account_name""",
    "filled_activities": f"""{_PLAIN}
        SELECT source, natural_key, r.contact_email AS contact_email, r.account_name AS account_name, 'activity' AS kind, r.subject AS subject, r.body AS body, r.occurred AS occurred_at,
               {_WHEN.format("r.arrival")} AS updated_at, r.hash AS content_hash
        FROM (SELECT source, natural_key, arg_max(a, {{'o': occurred, 'h': hash}}) AS r FROM applied a GROUP BY source, natural_key)""",
    "filled_ledger": f"""{_FAILING}
        SELECT source, natural_key, arg_max(hash, {{'o': occurred, 'h': hash}}) AS content_hash, max(occurred) AS occurred_at, CAST(max(version) AS BIGINT) AS version,
               {_WHEN.format("min(arrival)")} AS first_synced_at, {_WHEN.format("max(arrival)")} AS last_synced_at FROM applied GROUP BY source, natural_key""",
    "filled_cursors": f"{_PLAIN} SELECT source, max(occurred) AS cursor, {_SECOND} AS updated_at FROM decided GROUP BY source",
    "filled_dead_letters": f"{_FAILING}, {_DEAD} SELECT *, false AS resolved FROM dead2",
    "filled_audit": f"{_PLAIN} {_AUDIT}",
    "second_batch_counts": f"""{_FAILING},
        rows AS (SELECT source, decision, retries FROM decided WHERE arrival >= {SPLIT} UNION ALL SELECT source, 'dead_letter', 0 FROM staged WHERE error IS NOT NULL AND arrival >= {SPLIT}),
        cur AS (SELECT source, max(occurred) AS cursor_after, max(occurred) FILTER (arrival < {SPLIT}) AS cursor_before FROM decided GROUP BY source)
        SELECT source, any_value(cursor_after) AS cursor_after, any_value(cursor_before) AS cursor_before, count(*) FILTER (decision = 'unchanged') AS unchanged, count(*) FILTER (decision = 'created') AS created,
               count(*) FILTER (decision = 'updated') AS updated, count(*) FILTER (decision = 'conflict_ignored') AS conflict_ignored, count(*) FILTER (decision = 'dead_letter') AS dead_lettered,
               CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (decision <> 'dead_letter') AS processed FROM rows JOIN cur USING (source) GROUP BY source""",
    "calendar_since": """
        SELECT 'ev-' || event_id AS natural_key, strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS occurred_at, 'a folded line, and more' AS subject
        FROM (SELECT event_id, CASE event_id % 10 WHEN 0 THEN date_trunc('day', ts) WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS t FROM events)
        WHERE t IS NULL OR t > TIMESTAMP '2024-01-15'""",
    "calendar_file": "SELECT 'ev-' || event_id AS natural_key, event_type AS subject, props AS body, 'a@b.example' AS contact_email FROM events",
    "source_check": f"""{_PLAIN}
        SELECT arrival, CASE WHEN source NOT IN ('click', 'view', 'error') THEN 'unknown source ''' || source || '''' WHEN error IS NOT NULL THEN error
               WHEN n = 1 THEN 'extra must be an object, got array' WHEN n = 3 THEN 'extra must be an object, got string' END AS error, CASE WHEN n = 0 THEN '{{"a":"1"}}' ELSE '{{}}' END AS extra
        FROM (SELECT *, CAST(split_part(subject, ' ', 2) AS BIGINT) % 4 AS n FROM staged)""",
    "token_bucket": """
        WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r(user_id, n, event_id, us, taken, wait_us) AS (
            SELECT user_id, n, event_id, us, [us], CAST(NULL AS BIGINT) FROM e WHERE n = 1
            UNION ALL SELECT user_id, n, event_id, us, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END, CASE WHEN len(live) >= 2 THEN 21600000000 - (us - live[1]) END
            FROM (SELECT e.*, list_filter(r.taken, lambda x: e.us - x < 21600000000) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
        SELECT event_id, user_id, wait_us IS NULL AS admitted, wait_us FROM r""",
    "activities_in_order": f"""{_PLAIN}
        SELECT source, natural_key, arg_max(contact_email, {{'o': occurred, 'h': hash}}) AS contact_email, row_number() OVER (ORDER BY natural_key) - 1 AS pos
        FROM applied WHERE source = 'view' GROUP BY source, natural_key""",
    "dead_letters_in_order": f"""{_FAILING}, {_DEAD}
        SELECT source, natural_key, failure_count, CASE WHEN first_seen_at = {_FIRST} THEN 29.0 ELSE 5.0 END AS age_hours,
               CASE WHEN first_seen_at = {_FIRST} THEN '1d to 7d' ELSE '1h to 24h' END AS band, row_number() OVER (ORDER BY first_seen_at, source, natural_key) - 1 AS pos FROM dead2""",
    "week_dates": "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc FROM events",
    "store_commits": f"""{_FAILING},
        applied1 AS (SELECT * FROM applied WHERE arrival < {SPLIT}), ledger1 AS (SELECT DISTINCT source, natural_key FROM applied1)
        SELECT *, CAST(1 AS INT) AS version FROM ({_SNAPSHOT.format(ledger="ledger1", applied="applied1", where=f"WHERE arrival < {SPLIT}", also=f"AND arrival < {SPLIT}")})
        UNION ALL SELECT *, 2 FROM ({_SNAPSHOT.format(ledger="ledger", applied="applied", where="", also="")})""",
    "endpoint_tickets": """
        SELECT 'T-' || n_nationkey AS natural_key, n_name AS subject, 'SYNTHETIC ticket T-' || n_nationkey || ' status=' || CASE WHEN n_regionkey = 0 THEN 'Done' ELSE 'open' END AS body,
               'n' || n_nationkey || '@x.example' AS contact_email, CASE WHEN n_nationkey >= 8 THEN 'key,summary' ELSE '' END AS drifted FROM nation WHERE n_nationkey >= 6""",
    "endpoint_crm": """
        SELECT 'hubspot_contacts' AS source, CAST(n_nationkey AS VARCHAR) AS natural_key, 'n' || n_nationkey || '@x.example' AS contact_email, 'Contact ' || n_name AS subject,
               'SYNTHETIC HubSpot contact ' || n_nationkey || ' lifecyclestage=unset' AS body FROM nation WHERE n_nationkey >= 3 AND n_nationkey % 5 <> 0
        UNION ALL SELECT 'hubspot_deals', 'd' || n_nationkey, 'n' || CASE WHEN n_nationkey >= 3 AND n_nationkey % 5 <> 0 THEN n_nationkey ELSE n_nationkey + 1 END || '@x.example',
               'Deal ' || n_name, 'SYNTHETIC HubSpot deal d' || n_nationkey || ' stage=unset' FROM nation
        WHERE n_nationkey >= 2 AND (n_nationkey >= 3 AND n_nationkey % 5 <> 0 OR n_nationkey + 1 BETWEEN 3 AND 24 AND (n_nationkey + 1) % 5 <> 0)""",
    "panel_cursors": f"""{_FAILING}
        SELECT source, strftime(max(occurred), '%Y-%m-%d %H:%M:%S') AS cursor, {_TEXT_HOURS.format("greatest(0.0, date_diff('microseconds', max(occurred), TIMESTAMP '2024-02-01') / 3600000000.0)")} AS data_lag,
               '0 min' AS job_staleness FROM decided GROUP BY source""",
    "panel_writes": f"""{_FAILING}
        SELECT {_FIRST} AS bucket, count(*) FILTER (source = 'click') AS click, count(*) FILTER (source = 'error') AS error, count(*) FILTER (source = 'purchase') AS purchase,
               count(*) FILTER (source = 'signup') AS signup, count(*) FILTER (source = 'view') AS view FROM applied""",
    "panel_throughput": f"""{_FAILING},
        conflicts AS (SELECT DISTINCT source, natural_key, hash FROM decided WHERE decision = 'conflict_ignored'),
        notes AS (SELECT DISTINCT source, natural_key FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged'))
        SELECT s.source, (SELECT count(*) FROM ledger l WHERE l.source = s.source) AS records,
               (SELECT count(*) FROM decided d WHERE d.source = s.source AND decision = 'created') AS created, (SELECT count(*) FROM decided d WHERE d.source = s.source AND decision = 'updated') AS updated,
               (SELECT count(*) FROM conflicts c WHERE c.source = s.source) AS conflicts, (SELECT count(*) FROM notes n WHERE n.source = s.source) AS drift_notes,
               (SELECT count(*) FROM dead d WHERE d.source = s.source) AS dead_lettered_open, '0 min ago' AS last_write FROM (SELECT DISTINCT source FROM staged) s""",
    "panel_queue": f"{_FAILING} SELECT source, natural_key, category, error, failure_count, 'under 1h' AS band, '0 min' AS age FROM dead",
    "panel_deals": "SELECT o_orderstatus AS stage, count(*) AS deals, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS amount FROM orders GROUP BY 1",
}
ORACLE_SQL["ledger_buckets"] = ORACLE_SQL["filled_ledger"]
ORACLE_SQL["stored_counts"] = _METRICS["snapshot_counts"]
ORACLE_SQL["audit_of_dead_letters"] = f"{_FAILING} SELECT a.* FROM ({_AUDIT}) a SEMI JOIN dead USING (source, natural_key)"
