"""The ledger as the state of a stream: each record is judged against its key's stored version, wherever its key's state is kept.

There is no store and no second read of what is known: state lives with the partition of its key, as Spark checkpoints it. Keys
are dealt to buckets, whose records come to Python together, as a call for each key costs far more than its records do; of a
bucket's state only the keys that have records are read. A write that used up its attempts waits there with a timer, and is tried
again when that is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from millrace.model import CONFLICT, CREATED, DEAD, KEY, UNCHANGED, UPDATED
from millrace.operators.normalize import normalize

#: What comes of each record. tries: how often its write was given up before; the other columns are those of merge.decide().
OUTCOMES = (
    "source string, natural_key string, arrival long, occurred timestamp, content_hash string, old_hash string, decision string, version long, retries long, tries int"
)
_COLUMNS = [c.split()[0] for c in OUTCOMES.split(", ")]
#: Buckets that the keys of a stream are dealt to. It is part of what a checkpoint holds, so it stays.
BUCKETS = 1024
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one that keeps state in RocksDB, which state with timers needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value)
    return own


class _Ledger(StatefulProcessor):
    """Of a bucket: stored: the version that stands, by key; waiting: given-up writes by key and arrival, each with the time from which it is tried again."""

    def __init__(self, attempts: int, again_ms: int | None) -> None:
        self.attempts, self.again_ms = attempts, again_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("stored", "source string, natural_key string", "at long, content_hash string, version long")
        self.waiting = handle.getMapState("waiting", "source string, natural_key string, arrival long", "at long, content_hash string, fails long, tries int, due long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        for *of_key, at, content_hash, version in _rows(initialState, *KEY, "at", "content_hash", "version"):
            self.stored.updateValue(tuple(of_key), (at, content_hash, version))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list[tuple]] = {}
        for part in rows:
            for source, natural_key, *record in _rows(part, *KEY, "arrival", "at", "content_hash", "fails"):
                found.setdefault((source, natural_key), []).append((*record, 0))
        yield self._judged(found, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, found = expiredTimerInfo.getExpiryTimeInMs(), {}
        for (source, natural_key, arrival), (at, content_hash, fails, tries, then) in list(self.waiting.iterator()):
            if then <= due:
                self.waiting.removeKey((source, natural_key, arrival))
                found.setdefault((source, natural_key), []).append((arrival, at, content_hash, fails, tries))
        yield self._judged(found, timerValues)

    def _judged(self, found: dict[tuple, list[tuple]], timers: TimerValues) -> pd.DataFrame:
        """The outcomes of the records of each key, in order of arrival."""
        out = []
        for of_key, records in found.items():
            stored = before = self.stored.getValue(of_key)
            for record in sorted(records):
                stored, outcome = self._met(of_key, stored, *record, timers)
                out.append(outcome)
            if stored != before:
                self.stored.updateValue(of_key, stored)
        return pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def _met(self, key: tuple, stored, arrival: int, at: int, content_hash: str, fails: int, tries: int, timers: TimerValues):
        """What stands after a record, and the record's outcome."""
        old = stored[1] if stored else None
        due = CREATED if stored is None else UNCHANGED if content_hash == old else UPDATED if (at, content_hash) > tuple(stored[:2]) else CONFLICT
        version, retries, decision = None, 0, due
        if due in (CREATED, UPDATED):
            retries = min(fails, self.attempts - 1)
            if fails >= self.attempts:
                decision = DEAD
                if self.again_ms is not None:
                    then = timers.getCurrentProcessingTimeInMs() + self.again_ms
                    self.waiting.updateValue((*key, arrival), (at, content_hash, fails - self.attempts, tries + 1, then))
                    self.handle.registerTimer(then)
            else:
                version = (stored[2] if stored else 0) + 1
                stored = (at, content_hash, version)
        return stored, (*key, arrival, at, content_hash, old, decision, version, retries, tries)

    def close(self) -> None:
        pass


def _rows(df: pd.DataFrame, *columns: str) -> Iterator[tuple]:
    return zip(*(df[c].tolist() for c in columns), strict=True)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def ledger_outcomes(
    raw: DataFrame, *, attempts: int = 3, sources: tuple[str, ...] | None = None, again_ms: int | None = None, ledger: DataFrame | None = None,
) -> DataFrame:
    """The OUTCOMES of the usable records of a stream of raw ones; its session must be a stateful_session().

    Records of a key are taken in order of arrival within a micro-batch, and a task holds time and hash of those of one bucket at once, so
    a batch bounds what it holds. Records that come late are conflicts, never dropped; there is no watermark.
    ``again_ms``: given-up writes are tried again after so long, by a first micro-batch after that; else they stay given up. Each try uses up ``attempts``
    of a record's fail_times (if there is such a column). ``ledger``: what is known at the start (source, natural_key, content_hash, occurred_at, version).
    """
    fails = F.coalesce(F.col("fail_times"), F.lit(0)) if "fail_times" in raw.columns else F.lit(0)
    usable = normalize(raw, sources).filter("error IS NULL")
    rows = usable.select(_bucket(), *KEY, "arrival", F.unix_micros("occurred").alias("at"), "content_hash", fails.cast("long").alias("fails"))
    start = None if ledger is None else ledger.select(_bucket(), *KEY, F.unix_micros("occurred_at").alias("at"), "content_hash", "version").groupBy("bucket")
    kind = OUTCOMES.replace("occurred timestamp", "occurred long")
    found = rows.groupBy("bucket").transformWithStateInPandas(_Ledger(attempts, again_ms), kind, "Append", "None" if again_ms is None else "ProcessingTime", start)
    return found.withColumn("occurred", F.timestamp_micros("occurred")).select(*_COLUMNS)


def stored_versions(outcomes: DataFrame) -> DataFrame:
    """The ledger that the outcomes of a stream come to: hash, time and version of each key."""
    landed = outcomes.filter(F.col("decision").isin(CREATED, UPDATED))
    last = F.max_by(F.struct("content_hash", F.col("occurred").alias("occurred_at")), "version")
    return landed.groupBy(*KEY).agg(last.alias("v"), F.max("version").alias("version")).select(*KEY, "v.*", "version")
