from __future__ import annotations

import random
import time
from datetime import datetime
from pathlib import Path

import pytest

from millrace import lineage
from millrace.model import RAW_SCHEMA
from millrace.operators.merge import apply_batch, decide, empty_state
from millrace.operators.normalize import normalize
from millrace.plans import events, sync_queries
from millrace.streaming import ledger
from millrace.streaming.ledger import ledger_outcomes, stateful_session, stored_versions

NOW = datetime(2026, 5, 1)
SCHEMA = RAW_SCHEMA + ", fail_times int"


def raw(arrival, key, day, subject, fails=0):
    return (arrival, "email", key, "", f"2026-01-{day:02d}T00:00:00", subject, "", "a@b.c", "", "", "", None, [], fails)


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are delivered in the order of their times


def outcome(rows):
    return sorted((r["natural_key"], r["arrival"], r["decision"], r["version"], r["old_hash"], r["retries"]) for r in rows)


def stream(spark, folder):
    own = stateful_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    (folder / "in").mkdir(exist_ok=True)
    return own, own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(outcomes, folder):
    outcomes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()


def test_a_stream_decides_what_a_batch_decides(spark, tmp_path):
    draw = random.Random(3)
    rows = [raw(i, f"k{draw.randrange(4)}", 1 + draw.randrange(9), f"s{draw.randrange(6)}", draw.randrange(5)) for i in range(120)] + [raw(120, "", 1, "no key")]
    start = [raw(-1, "k0", 5, "s0"), raw(-2, "old", 1, "s0")]
    known, _ = apply_batch(empty_state(spark), spark.createDataFrame(start, SCHEMA), now=NOW)
    known["ledger"].write.parquet(f"{tmp_path}/ledger")
    own, given = stream(spark, tmp_path)
    for at in range(0, 121, 30):
        write(spark, rows[at : at + 30], f"{tmp_path}/in")
        if at != 30:  # one start takes two files in two batches, the others one each from the checkpoint
            drained(ledger_outcomes(given, ledger=own.read.parquet(f"{tmp_path}/ledger")), tmp_path)
    found = spark.read.parquet(f"{tmp_path}/out")
    valid = normalize(spark.createDataFrame(rows, SCHEMA), None).filter("error is null")
    assert outcome(found.collect()) == outcome(decide(valid, known["ledger"]).collect())
    after, _ = apply_batch(known, spark.createDataFrame(rows, SCHEMA), now=NOW)
    want = {r["natural_key"]: (r["content_hash"], r["version"]) for r in after["ledger"].collect()}
    got = {r["natural_key"]: (r["content_hash"], r["version"]) for r in stored_versions(found).collect()}
    assert all(want[k] == v for k, v in got.items()) and got.keys() >= {"k1", "k2", "k3"}


def test_given_up_writes_are_tried_again_when_they_are_due(spark, tmp_path):
    """a lands at its third try; b is overtaken by a newer version while it waits; c is given up once and lands."""
    write(spark, [raw(1, "a", 1, "x", 7), raw(2, "b", 1, "x", 3), raw(3, "c", 1, "x", 4), raw(4, "b", 2, "y")], f"{tmp_path}/in")
    own, given = stream(spark, tmp_path)
    query = (
        ledger_outcomes(given, again_ms=500).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start(f"{tmp_path}/out")
    )
    try:
        until, rows = time.time() + 120, []
        while time.time() < until and sum(r["decision"] in ("created", "conflict_ignored") for r in rows) < 4:
            time.sleep(1)
            assert query.isActive, query.exception()
            rows = spark.read.schema(given.sparkSession.createDataFrame([], "natural_key string, arrival long, decision string, tries int, version long").schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
    assert sorted((r["natural_key"], r["arrival"], r["tries"], r["decision"], r["version"]) for r in rows) == [
        ("a", 1, 0, "dead_letter", None), ("a", 1, 1, "dead_letter", None), ("a", 1, 2, "created", 1), ("b", 2, 0, "dead_letter", None), ("b", 2, 1, "conflict_ignored", None),
        ("b", 4, 0, "created", 1), ("c", 3, 0, "dead_letter", None), ("c", 3, 1, "created", 1),
    ]


def test_records_meet_the_state_in_their_order_however_many_files_they_come_in(spark, monkeypatch):
    monkeypatch.setattr(sync_queries, "raw_events", lambda *a, **k: events.raw_events(*a, **k).repartition(20))
    small = {"spark.sql.files.maxPartitionBytes": "60000b", "spark.sql.files.openCostInBytes": "1b"}  # a table of 20 files is read in as many parts at least
    for k, v in small.items():
        spark.conf.set(k, v)
    sf = "/root/testdata/sf0.01"
    try:
        found = sync_queries.ledger_stream(spark, sf)
    finally:
        for k in small:
            spark.conf.unset(k)
    want = sync_queries.ledger_state_after_failures(spark, sf)
    assert sorted(found.collect()) == sorted(want.select(found.columns).collect())


def test_keys_of_a_bucket_do_not_mix_and_nothing_but_outcomes_and_state_stays_on_disk(spark, tmp_path, monkeypatch):
    """All keys in one bucket, some null or known before; two starts."""
    monkeypatch.setattr(ledger, "BUCKETS", 1)
    draw = random.Random(9)
    rows = [(i, draw.choice(["email", "tickets", None]), *raw(i, f"k{draw.randrange(12)}", 1 + draw.randrange(9), f"s{draw.randrange(5)}", draw.randrange(5))[2:]) for i in range(150)]
    known, _ = apply_batch(empty_state(spark), spark.createDataFrame([raw(-1 - i, f"k{i}", 5, "s0") for i in range(4)], SCHEMA), now=NOW)
    known["ledger"].write.parquet(f"{tmp_path}/ledger")
    own, given = stream(spark, tmp_path)
    for part in (rows[:80], rows[80:]):
        write(spark, part, f"{tmp_path}/in")
        drained(ledger_outcomes(given, ledger=own.read.parquet(f"{tmp_path}/ledger")), tmp_path)
    found = [r for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(r["arrival"] for r in found) == list(range(150))
    valid = normalize(spark.createDataFrame([r for r in rows if r[1]], SCHEMA), None).filter("error is null")
    assert outcome(r for r in found if r["source"]) == outcome(decide(valid, known["ledger"]).collect())


def test_ledger_stream_of_nothing_is_empty_and_its_input_does_not_stay(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    source.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert sync_queries.ledger_stream(spark, f"{tmp_path}/none").isEmpty()
    folders = lambda: {str(p) for p in Path(lineage.own_dir(spark).removeprefix("file:")).rglob("*.parquet") if "/out/" not in str(p)}
    before = folders()
    assert not sync_queries.ledger_stream(spark, "/root/testdata/sf0.01").isEmpty()
    left = sum(Path(p).stat().st_size for p in folders() - before)
    assert left < 200_000  # the arrivals; all records as they came in were 1 MB and more, three times over
