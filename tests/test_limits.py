from __future__ import annotations

import random
from collections import defaultdict

import pytest

from millrace.operators import limits


def in_order(rows, quota, window):
    """One request after the other."""
    out, taken = [], defaultdict(list)
    for client, at, number in sorted(rows):
        live = taken[client] = [t for t in taken[client] if at - t < window]
        out.append((client, at, number, window - (at - live[0]) if len(live) >= quota else None))
        if len(live) < quota:
            live.append(at)
    return sorted(out, key=str)


def judged(spark, rows, quota, window, slices):
    df = spark.createDataFrame([(*r, 0) for r in rows], "client string, at_us long, number long, wait int").repartition(5)
    return sorted(map(tuple, limits.admitted(df, quota, window, slices=slices).collect()), key=str)


def jobs(monkeypatch):
    calls = []
    monkeypatch.setattr(limits, "_leaves", lambda *a, f=limits._leaves: calls.append(len(a[2])) or f(*a))
    return calls


@pytest.mark.parametrize(("quota", "window", "step", "rounds"), [(1, 50, 9, 1), (2, 50, 12, 1), (3, 1000, 3, None), (2, 3, 40, 0)])
def test_slices_equal_one_request_after_the_other(spark, monkeypatch, quota, window, step, rounds):
    """One client has most of the requests and never, or often, pauses; some requests come at one moment, some twice."""
    draw, rows, at = random.Random(quota * window), [], 0
    for i in range(600):
        at += draw.randrange(step * 2)
        rows.append(("hot", at, i))
    for i in range(200):
        rows.append((f"c{draw.randrange(20)}", draw.randrange(3000), i))
    rows += rows[:40]
    calls = jobs(monkeypatch)
    assert judged(spark, rows, quota, window, 12) == in_order(rows, quota, window)
    if rounds is not None:
        assert len(calls) <= rounds  # few requests in a window: all slices at once
    else:
        assert len(calls) > 3  # many: a slice after the other


def test_no_requests_and_no_clients(spark):
    none = spark.createDataFrame([(None, 1, 1), ("a", None, 1)], "client string, at_us long, number long")
    assert limits.admitted(none, 1, 10).collect() == []
    assert judged(spark, [("a", 5, 1)], 1, 10, 3) == [("a", 5, 1, None)]


def test_states_are_counted_before_they_are_made():
    assert limits.states([3, 1], 1) == [(), (1,), (3,)]
    assert limits.states(list(range(40)), 20) is None and len(limits.states(list(range(20)), 2)) == 211
