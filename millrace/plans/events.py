"""The events table as a stream of records to sync, in Spark and in SQL.

Each event is a record of the source that its type names, keyed by its user. All events are delivered twice, out of
order; low values stand for records that validation refuses.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import cut
from millrace.model import DRIFT
from millrace.operators.merge import State, apply_batch, decide, empty_state
from millrace.operators.normalize import normalize

AS_OF = datetime(2024, 2, 1)
#: A prime, for an order of arrival that is not that of the events, and what the second delivery is behind by.
_PRIME, _STEP, _LATER = 1_000_003, 7919, 1 << 40
#: Rows of a table that one task takes at most, where each row is parsed or hashed.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data; the engine's times are UTC, so the session's are, too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """df over all cores, ``task_rows`` to a task at most. A row group goes to one task however many parts its file is cut into, so the
    rows of the parts are counted (by the footers), not the parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    total, most = df.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    even = df.rdd.getNumPartitions() >= cores and most <= task_rows and most * cores <= 2 * total
    return df if even else df.repartition(max(cores, math.ceil(total / task_rows)), *df.columns)  # by all columns, which needs no sort


def raw_events(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    """Raw records of all events; with ``failing``, writes of some fail up to four times."""
    e = dealt(table(spark, sf_dir, "events"))
    text, value, user = lambda c: F.col(c).cast("string"), F.col("value"), F.col("user_id").cast("string")
    arrival = F.floor(F.col("event_id") / _PRIME) * _PRIME + F.pmod(F.col("event_id") * _STEP, F.lit(_PRIME))
    account = F.concat(F.lit("acct"), (F.col("user_id") % 20).cast("string"))
    note = F.struct(F.lit("alias_used").alias("kind"), F.lit("value").alias("field"), F.lit("arrived as 'val', expected 'value'").alias("detail"))
    rows = e.select(
        F.explode(F.array(arrival, arrival + _LATER)).alias("arrival"),
        F.col("event_type").alias("source"),
        F.when(value.between(5, 6), " ").otherwise(user).alias("natural_key"),
        F.lit("").alias("kind"),
        F.when((value > 6) & (value < 7), "not a date").when((value >= 7) & (value < 8), "")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("occurred_at"),
        F.concat(F.lit("event "), text("event_id")).alias("subject"),
        F.col("props").alias("body"),
        F.concat(F.lit("user"), user, F.when(value < 5, "").otherwise(F.concat(F.lit("@"), account, F.lit(".example")))).alias("contact_email"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("User "), user, F.lit(" "), "event_type")).alias("contact_name"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(account).alias("account_name"),
        F.concat("event_type", F.lit(".example")).alias("account_domain"),
        F.lit(None).cast("map<string,string>").alias("extra"),
        F.when(F.col("event_id") % 2 == 0, F.array(note)).otherwise(F.array().cast(DRIFT)).alias("drift"),
        *([(F.col("event_id") % 5).cast("int").alias("fail_times")] if failing else []),
    )
    return rows


def decided_events(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    valid = cut(normalize(raw_events(spark, sf_dir, failing), None).filter("error is null"))  # decide() reads it more than once
    return decide(valid, empty_state(spark)["ledger"])


def synced_events(spark: SparkSession, sf_dir: str, failing: bool = False) -> State:
    """The tables after one run over all events."""
    return apply_batch(empty_state(spark), raw_events(spark, sf_dir, failing), now=AS_OF, sources=None)[0]


#: CTEs for the same in SQL: raw, staged (with error and hash), decided (with fail_times from F) and dead (one row per failure).
RAW_SQL = r"""
    raw AS (
        SELECT unnest([e.arrival, e.arrival + 1099511627776]) AS arrival, event_type AS source,
               CASE WHEN value BETWEEN 5 AND 6 THEN '' ELSE CAST(user_id AS VARCHAR) END AS natural_key,
               CASE WHEN value > 6 AND value < 7 THEN 'not a date' WHEN value >= 7 AND value < 8 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS occurred_at,
               ts AS occurred, 'event ' || event_id AS subject, props AS body,
               'user' || user_id || CASE WHEN value < 5 THEN '' ELSE '@acct' || (user_id % 20) || '.example' END AS contact_email,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE 'User ' || user_id || ' ' || event_type END AS contact_name,
               CASE WHEN user_id % 7 = 0 THEN '' ELSE 'acct' || (user_id % 20) END AS account_given,
               event_type || '.example' AS account_domain, event_id % 2 = 0 AS drifted, CAST(event_id % 5 AS INT) AS fail_times
        FROM (SELECT *, (event_id // 1000003) * 1000003 + (event_id * 7919) % 1000003 AS arrival FROM events) e
    ),
    named AS (
        SELECT *, CASE WHEN account_given = '' THEN split_part(contact_email, '@', 2) ELSE account_given END AS account_name,
               strftime(occurred, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', occurred) % 1000000 = 0 THEN '' ELSE strftime(occurred, '.%f') END || '+00:00' AS iso,
               CASE WHEN natural_key = '' THEN 'missing natural key' WHEN occurred_at = '' THEN 'missing occurred_at timestamp'
                    WHEN occurred_at = 'not a date' THEN 'unparseable occurred_at ''not a date'''
                    WHEN instr(contact_email, '@') = 0 THEN 'missing or invalid contact_email ''' || contact_email || '''' END AS error
        FROM raw
    ),
    staged AS (
        SELECT *, sha256('{"account_domain":"' || account_domain || '","account_name":"' || account_name || '","body":"' || replace(body, '"', '\"')
                   || '","contact_email":"' || contact_email || '","contact_name":"' || contact_name || '","kind":"activity","occurred_at":"' || iso
                   || '","subject":"' || subject || '"}') AS hash,
               '{"kind":"","occurred_at":"' || occurred_at || '","subject":"' || subject || '","body":"' || replace(body, '"', '\"') || '","contact_email":"' || contact_email
                   || '","contact_name":"' || contact_name || '","account_name":"' || account_given || '","account_domain":"' || account_domain || '","drift":['
                   || CASE WHEN drifted THEN '{"kind":"alias_used","field":"value","detail":"arrived as ''val'', expected ''value''"}' ELSE '' END || ']}' AS payload_json
        FROM named
    )"""


def decided_sql(failing: bool = False) -> str:
    """All CTEs up to decided (a row per usable record) and dead (a row per failure)."""
    fails = "fail_times" if failing else "0"
    return f"""WITH {RAW_SQL},
    met AS (
        SELECT *, {fails} AS fails, max(CASE WHEN {fails} < 3 THEN {{'o': occurred, 'h': hash}} END)
                  OVER (PARTITION BY source, natural_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM staged WHERE error IS NULL
    ),
    due AS (
        SELECT *, CASE WHEN prev IS NULL THEN 'created' WHEN prev.h = hash THEN 'unchanged'
                       WHEN occurred > prev.o OR (occurred = prev.o AND hash > prev.h) THEN 'updated' ELSE 'conflict_ignored' END AS due FROM met
    ),
    judged AS (SELECT *, CASE WHEN due IN ('created', 'updated') AND fails >= 3 THEN 'dead_letter' ELSE due END AS decision,
                      CASE WHEN due IN ('created', 'updated') THEN least(fails, 2) ELSE 0 END AS retries FROM due),
    decided AS (SELECT *, count(*) FILTER (decision IN ('created', 'updated')) OVER (PARTITION BY source, natural_key ORDER BY arrival) AS version FROM judged),
    applied AS (SELECT * FROM decided WHERE decision IN ('created', 'updated')),
    failures AS (
        SELECT arrival, source, CASE WHEN natural_key = '' THEN source || ':no-key:' || left(sha256(payload_json), 16) ELSE natural_key END AS natural_key,
               error, CASE WHEN natural_key = '' THEN 'poison_no_key' ELSE 'poison' END AS category FROM staged WHERE error IS NOT NULL
        UNION ALL SELECT arrival, source, natural_key, 'retry budget exhausted', 'transient_exhausted' FROM decided WHERE decision = 'dead_letter'
    ),
    dead AS (
        SELECT source, natural_key, arg_max(error, arrival) AS error, arg_max(category, arrival) AS category, count(*) AS failure_count
        FROM failures GROUP BY source, natural_key
    ),
    ledger AS (
        SELECT source, natural_key, arg_max(hash, {{'o': occurred, 'h': hash}}) AS content_hash, max(occurred) AS occurred_at, max(version) AS version
        FROM applied GROUP BY source, natural_key
    )"""
