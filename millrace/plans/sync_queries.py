"""Queries over the merge: decisions, the tables it leaves, its audit trail and its dead letters."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import delete, move, own_dir, packed, tidy
from millrace.model import KEY
from millrace.operators.merge import applied, apply_batch, conflict_audit, drift_audit, empty_state, reprocess, write_audit
from millrace.operators.normalize import dead_letters, normalize
from millrace.plans.events import AS_OF, decided_events, decided_sql, raw_events, synced_events
from millrace.streaming.ledger import OUTCOMES, ledger_outcomes, stateful_session, stored_versions


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _per_decision(decided: DataFrame) -> DataFrame:
    return decided.groupBy("source", "decision").agg(F.count("*").alias("n"), F.sum("retries").alias("retries"))


def ledger_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_decision(decided_events(spark, sf_dir))


def transient_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_decision(decided_events(spark, sf_dir, failing=True))


def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(synced_events(spark, sf_dir)["ledger"].select(*KEY, "content_hash", "occurred_at", "version"), "occurred_at")


def ledger_state_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(synced_events(spark, sf_dir, failing=True)["ledger"].select(*KEY, "content_hash", "occurred_at", "version"), "occurred_at")


def ledger_stream(spark: SparkSession, sf_dir: str, batch_rows: int = 1 << 22) -> DataFrame:
    """The ledger that a stream of the same records comes to, in micro-batches, its state kept by key.

    A micro-batch takes whatever files are there, in no order that Spark promises, so each range of arrival is written when the stream has
    taken all of the one before: there are three at least, of some ``batch_rows`` records at most.
    """
    folder = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    raw = raw_events(spark, sf_dir, failing=True)
    arrivals = packed(raw.select("arrival"))
    n = max(3, math.ceil(arrivals.count() / batch_rows))
    bounds = sorted(set(arrivals.approxQuantile("arrival", [i / n for i in range(1, n)], 0.1 / n)))
    with tidy(spark):  # a folder for each range
        raw.withColumn("range", sum([(F.col("arrival") >= int(b)).cast("int") for b in bounds], F.lit(0))).write.partitionBy("range").parquet(f"{folder}/ranges")
    own = stateful_session(spark)
    cores = spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.shuffle.partitions", min(int(own.conf.get("spark.sql.shuffle.partitions")), 2 * cores))  # each opens and commits its state in every micro-batch
    given = None
    for i in range(len(bounds) + 1):
        move(spark, f"{folder}/ranges/range={i}", f"{folder}/in/{i}")
        given = given or own.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        sink = ledger_outcomes(given).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        delete(spark, f"{folder}/in/{i}")
    return _ntz(stored_versions(spark.read.schema(OUTCOMES).parquet(f"{folder}/out")), "occurred_at")


def activities_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(synced_events(spark, sf_dir)["activities"].select(*KEY, "contact_email", "account_name", "kind", "subject", "body", "occurred_at"), "occurred_at")


def contact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced_events(spark, sf_dir)["contacts"].select("email", "full_name")


def account_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced_events(spark, sf_dir)["accounts"].select("name", "domain")


def cursor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(synced_events(spark, sf_dir)["cursors"].select("source", "cursor"), "cursor")


def write_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_audit(decided_events(spark, sf_dir), AS_OF).drop("at")


def conflict_audit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_audit(decided_events(spark, sf_dir), empty_state(spark)["audit"], AS_OF).drop("at", "action")


def drift_audit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_audit(decided_events(spark, sf_dir), empty_state(spark)["audit"], AS_OF).select(*KEY, "action", "detail")


def second_run_is_a_no_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a run over what is in the store already: nothing is written."""
    state = synced_events(spark, sf_dir)
    again, stats = apply_batch(state, raw_events(spark, sf_dir), now=AS_OF, sources=None)
    return stats.select("source", "created", "updated", "unchanged", "conflict_ignored", "dead_lettered", "processed")


def poison_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = normalize(raw_events(spark, sf_dir), None).filter("error is not null")
    return dead_letters(bad).select("arrival", *KEY, "error", "category")


def dead_letter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synced_events(spark, sf_dir, failing=True)["dead_letter"].select(*KEY, "error", "category", "failure_count", "resolved")


def dead_letter_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = reprocess(synced_events(spark, sf_dir, failing=True), now=AS_OF, sources=None)
    return state["dead_letter"].select(*KEY, "category", "failure_count", "resolved")


def first_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the records of a source changed after they were created."""
    landed = applied(decided_events(spark, sf_dir))
    return landed.groupBy("source").agg(F.count("*").alias("writes"), F.max("version").alias("max_version"), F.countDistinct("natural_key").alias("records"))


QUERIES = {
    "ledger_decisions": ledger_decisions,
    "transient_exhaustion": transient_exhaustion,
    "ledger_state": ledger_state,
    "ledger_state_after_failures": ledger_state_after_failures,
    "ledger_stream": ledger_stream,
    "activities_state": activities_state,
    "contact_upsert": contact_upsert,
    "account_upsert": account_upsert,
    "cursor_state": cursor_state,
    "write_audit_trail": write_audit_trail,
    "conflict_audit_once": conflict_audit_once,
    "drift_audit_once": drift_audit_once,
    "second_run_is_a_no_op": second_run_is_a_no_op,
    "poison_split": poison_split,
    "dead_letter_upsert": dead_letter_upsert,
    "dead_letter_reprocess": dead_letter_reprocess,
    "first_versions": first_versions,
}

_PLAIN, _FAILING = decided_sql(), decided_sql(failing=True)
_DECISIONS = "SELECT source, decision, count(*) AS n, CAST(sum(retries) AS BIGINT) AS retries FROM decided GROUP BY source, decision"
_LEDGER = "SELECT source, natural_key, content_hash, occurred_at, CAST(version AS BIGINT) AS version FROM ledger"

ORACLE_SQL = {
    "ledger_decisions": f"{_PLAIN} {_DECISIONS}",
    "transient_exhaustion": f"{_FAILING} {_DECISIONS}",
    "ledger_state": f"{_PLAIN} {_LEDGER}",
    "ledger_state_after_failures": f"{_FAILING} {_LEDGER}",
    "ledger_stream": f"{_FAILING} {_LEDGER}",
    "activities_state": f"""{_PLAIN}
        SELECT source, natural_key, r.contact_email AS contact_email, r.account_name AS account_name, 'activity' AS kind, r.subject AS subject, r.body AS body, r.occurred AS occurred_at
        FROM (SELECT source, natural_key, arg_max(a, {{'o': occurred, 'h': hash}}) AS r FROM applied a GROUP BY source, natural_key)""",
    "contact_upsert": f"""{_PLAIN}
        SELECT contact_email AS email, coalesce(arg_max(contact_name, arrival) FILTER (contact_name <> ''), '') AS full_name FROM applied GROUP BY contact_email""",
    "account_upsert": f"{_PLAIN} SELECT account_name AS name, arg_min(account_domain, arrival) AS domain FROM applied GROUP BY account_name",
    "cursor_state": f"{_PLAIN} SELECT source, max(occurred) AS cursor FROM decided GROUP BY source",
    "write_audit_trail": f"""{_PLAIN}
        SELECT source, natural_key, decision AS action, prev.h AS old_hash, hash AS new_hash, 'version ' || version AS detail FROM applied""",
    "conflict_audit_once": f"""{_PLAIN}
        SELECT source, natural_key, arg_min(prev.h, arrival) AS old_hash, hash AS new_hash,
               'incoming occurred_at ' || any_value(iso) || ' older than stored; last-write-wins keeps stored' AS detail
        FROM decided WHERE decision = 'conflict_ignored' GROUP BY source, natural_key, hash""",
    "drift_audit_once": f"""{_PLAIN}
        SELECT DISTINCT source, natural_key, 'schema_drift' AS action, 'alias_used: value (arrived as ''val'', expected ''value'')' AS detail
        FROM decided WHERE drifted AND decision IN ('created', 'updated', 'unchanged')""",
    "second_run_is_a_no_op": f"""{_PLAIN}
        SELECT s.source, 0 AS created, 0 AS updated, count(*) FILTER (s.error IS NULL AND s.hash = l.content_hash) AS unchanged,
               count(*) FILTER (s.error IS NULL AND s.hash <> l.content_hash) AS conflict_ignored, count(*) FILTER (s.error IS NOT NULL) AS dead_lettered,
               count(*) FILTER (s.error IS NULL) AS processed
        FROM staged s LEFT JOIN ledger l ON s.source = l.source AND s.natural_key = l.natural_key GROUP BY s.source""",
    "poison_split": f"{_PLAIN} SELECT arrival, source, natural_key, error, category FROM failures",
    "dead_letter_upsert": f"{_FAILING} SELECT source, natural_key, error, category, failure_count, false AS resolved FROM dead",
    "dead_letter_reprocess": f"""{_FAILING}
        SELECT source, natural_key, category, failure_count + CASE WHEN category = 'transient_exhausted' THEN 0 ELSE 1 END AS failure_count,
               category = 'transient_exhausted' AS resolved FROM dead""",
    "first_versions": f"""{_PLAIN}
        SELECT source, count(*) AS writes, CAST(max(version) AS BIGINT) AS max_version, count(DISTINCT natural_key) AS records FROM applied GROUP BY source""",
}
