"""What runs leave on disk, and that taking a batch in portions changes nothing."""

from __future__ import annotations

import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import lineage
from millrace.model import DRIFT, RAW_SCHEMA
from millrace.operators.merge import apply_batch, decide, empty_state
from millrace.operators.normalize import normalize
from millrace.operators.store import Store
from millrace.plans import batch_queries, source_queries
from millrace.sources.json_arrays import read_json_arrays, write_json_arrays

NOW, LATER = datetime(2026, 1, 10), datetime(2026, 1, 11)


def size(*folders):
    return sum(os.lstat(f"{at}/{f}").st_size for folder in folders for at, _, files in os.walk(folder) for f in files if not f.endswith(".crc"))


def own(spark):
    return size(lineage.own_dir(spark).removeprefix("file:"))


def shuffled(spark):
    return size(*[d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()])


def settled(spark, most):
    """Bytes of shuffles once they are below ``most``; Spark deletes them aside."""
    until = time.time() + 20
    while shuffled(spark) > most and time.time() < until:
        time.sleep(0.2)
    return shuffled(spark)


def rows(spark, n):
    """n records of 256 bytes that nothing packs, one of each key."""
    text = F.concat(*[F.sha2(F.concat_ws("-", F.lit(i), "id"), 256) for i in range(4)])
    none = F.lit("")
    return spark.range(n).select(
        F.col("id").alias("arrival"), F.lit("email").alias("source"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("natural_key"), none.alias("kind"), F.lit("2026-01-01T00:00:00").alias("occurred_at"),
        none.alias("subject"), text.alias("body"), F.lit("a@b.c").alias("contact_email"), none.alias("contact_name"), none.alias("account_name"), none.alias("account_domain"),
        F.lit(None).cast("map<string,string>").alias("extra"), F.array().cast(DRIFT).alias("drift"),
    )


def test_a_run_that_changes_nothing_leaves_little_on_disk(spark):
    raw = rows(spark, 20_000)
    state, _ = apply_batch(empty_state(spark), raw, now=NOW)
    held, files = shuffled(spark), own(spark)
    _, stats = apply_batch(state, raw, now=LATER)
    assert own(spark) - files < 1_000_000
    assert settled(spark, held + 500_000) <= held + 500_000
    assert stats.first()["unchanged"] == 20_000


@pytest.mark.parametrize("most", [1 << 23, 40])
def test_a_run_in_portions_makes_what_decisions_say(spark, monkeypatch, most):
    """Keys that land in one slice of arrival, in several, in none, and after those of an earlier run; some fail."""
    monkeypatch.setattr(lineage, "PORTION_ROWS", most)
    draw = random.Random(5)

    def batch(n, keys):
        line = lambda i: (i << 18, "email", draw.choice(keys), "", f"2026-01-0{draw.randrange(1, 9)}T00:00:00", f"s{draw.randrange(4)}", "", "a@b.c", "", "", "", None, [], draw.choice([0, 0, 1, 3]))
        return spark.createDataFrame([line(i) for i in range(n)], RAW_SCHEMA + ", fail_times int")

    state = empty_state(spark)
    for raw in (batch(150, [f"k{i}" for i in range(60)]), batch(150, ["k1", "k2", "hot", *[f"n{i}" for i in range(90)]])):
        want = decide(normalize(raw).filter("error is null"), state["ledger"]).collect()
        before = {r["natural_key"]: r["version"] for r in state["ledger"].collect()}
        audited = state["audit"].count()
        state, stats = apply_batch(state, raw, now=NOW)
        landed = [r for r in want if r["version"] is not None]
        versions = before | {r["natural_key"]: r["version"] for r in sorted(landed, key=lambda r: r["version"])}
        assert {r["natural_key"]: r["version"] for r in state["ledger"].collect()} == versions
        last = {r["natural_key"]: r["subject"] for r in sorted(landed, key=lambda r: r["version"])}
        found = {r["natural_key"]: r["subject"] for r in state["activities"].collect()}
        assert found.keys() == versions.keys() and {k: found[k] for k in last} == last
        conflicts = {(r["natural_key"], r["content_hash"]) for r in want if r["decision"] == "conflict_ignored"}
        writes = [(r["natural_key"], r["detail"]) for r in state["audit"].filter("action in ('created', 'updated')").collect()]
        assert set(writes) >= {(r["natural_key"], f"version {r['version']}") for r in landed}
        assert len(landed) <= state["audit"].count() - audited <= len(landed) + len(conflicts)
        row = stats.first()
        assert [row[k] for k in ("created", "updated", "unchanged", "conflict_ignored", "dead_lettered")] == [
            sum(r["decision"] == k for r in want) for k in ("created", "updated", "unchanged", "conflict_ignored", "dead_letter")
        ]


def test_a_store_keeps_nothing_that_a_commit_was_made_of(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "PORTION_ROWS", 5_000)
    raw, held, files = rows(spark, 20_000), shuffled(spark), own(spark)
    store = Store(spark, str(tmp_path / "store"))
    assert store.merge(raw, now=NOW).first()["created"] == 20_000
    assert own(spark) - files < 100_000
    assert settled(spark, held + 500_000) <= held + 500_000
    found = store.read()
    assert found["audit"].select("natural_key").distinct().count() == found["audit"].count() == found["ledger"].count() == 20_000


def test_counts_of_stored_tables_leave_no_shuffle(spark):
    held = shuffled(spark)
    files = own(spark)
    counts = {r["table"]: r["n"] for r in batch_queries.stored_counts(spark, "/root/testdata/sf0.01").collect()}
    assert counts["ledger"] == counts["activities"] > 0
    assert settled(spark, held + 500_000) <= held + 500_000
    assert own(spark) - files < 5_000_000


def test_sources_that_were_read_do_not_stay(spark):
    held, files = shuffled(spark), own(spark)
    found = source_queries.sync_of_files(spark, "/root/testdata/sf0.01")
    assert own(spark) - files < 2_500_000  # the texts alone were more
    assert settled(spark, held + 500_000) <= held + 500_000
    assert found.select("source", "natural_key").distinct().count() == found.count() == 28_000


def test_compressed_arrays_are_read_back(spark, tmp_path):
    rows = spark.range(2_000).select(F.concat(F.lit('{"n": "}{'), F.col("id").cast("string"), F.lit('", "a": [{}]}')).alias("value"))
    write_json_arrays(rows.repartition(3), f"{tmp_path}/rows.json", "gzip")
    assert len(list((tmp_path / "rows.json").glob("*.gz"))) >= 3
    found = read_json_arrays(spark, f"{tmp_path}/rows.json")
    assert sorted(r["value"] for r in found.collect()) == sorted(r["value"] for r in rows.collect())
    assert found.select("arrival").distinct().count() == 2_000
