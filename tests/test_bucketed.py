from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from millrace.lineage import cut
from millrace.model import RAW_SCHEMA
from millrace.operators import bucketed
from millrace.operators.merge import apply_batch, decide, empty_state
from millrace.operators.normalize import normalize

NOW, LATER = datetime(2026, 5, 1), datetime(2026, 5, 2)


def raw(spark, rows):
    return spark.createDataFrame([(i, "email", k, "", f"2026-01-{d:02d}T00:00:00", f"s{d}", "", "a@b.c", "", "", "", None, []) for i, (k, d) in enumerate(rows)], RAW_SCHEMA)


def above_the_ledger(df):
    """What stands above each scan of the ledger, up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+*\-()0-9]*", line)[0])
    found = []
    for i, line in enumerate(lines):
        if "Scan parquet" in line and "ledger_" in line:
            at, names = depth(line), [line]
            for up in reversed(lines[:i]):
                if depth(up) < at:
                    at = depth(up)
                    names.append(up.strip(" :+-*()0123456789"))
                    if "Join" in up:
                        break
            found.append(names)
    return found


def test_a_second_batch_does_not_shuffle_the_ledger(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = raw(spark, [(f"k{i}", 1 + i % 9) for i in range(40)])
        second = raw(spark, [(f"k{i}", 5) for i in range(0, 60, 3)] + [("k0", 9), ("k1", 1)])
        before, _ = apply_batch(empty_state(spark), first, now=NOW)
        name = f"ledger_{uuid.uuid4().hex}"
        ledger = bucketed.save_ledger(before["ledger"], name)
        valid = cut(normalize(second).filter("error is null"))
        decided = decide(valid, ledger)
        merged = bucketed.merged_ledger(ledger, cut(decided), LATER)
        for df in (decided, merged):
            scans = above_the_ledger(df)
            assert scans and all("Bucketed: true" in s[0] and "Join" in s[-1] and not any(n.startswith("Exchange") for n in s[1:]) for s in scans), scans
        want, _ = apply_batch(before, second, now=LATER)
        rows = lambda df: sorted(map(tuple, df.select(*ledger.columns).collect()))
        after = bucketed.save_ledger(merged, f"{name}_after")
        assert rows(after) == rows(want["ledger"])
        folder = after.inputFiles()[0].rsplit("/", 1)[0]
        again = bucketed.open_ledger(spark, f"{name}_again", folder, bucketed.buckets_for(spark, after.count()))
        assert rows(again) == rows(after)
        third = decide(valid, again)
        assert all(not any(n.startswith("Exchange") for n in s[1:]) for s in above_the_ledger(third))
        assert third.filter(F.col("decision").isin("created", "updated")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucketed.buckets_for(spark, 10) == least and bucketed.buckets_for(spark, 5_000_000 * least * 3 + 1) == 3 * least + 1
