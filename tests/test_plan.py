from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from millrace.model import TABLES
from millrace.operators import graph, metrics, report, rules
from millrace.operators.projections import merge_milestones

AS_OF = date(2026, 4, 20)
TICKETS = "ticket_key string, milestone_key string, status string, is_open boolean, due_date date"


def milestone(key, end, actual=None, status="planned", owner="o@x.com"):
    return (key, f"name {key}", "Acme", owner, date(2026, 1, 1), end, actual, status)


def tables(spark, rows, deps):
    return spark.createDataFrame(rows, TABLES["milestones"]), spark.createDataFrame(deps, TABLES["milestone_deps"])


def slips(spark, rows, deps):
    return {r["milestone_key"]: r["slip_days"] for r in graph.plan(*tables(spark, rows, deps), AS_OF).collect()}


def day(n):
    return AS_OF + timedelta(days=n)


def test_slip_cases(spark):
    rows = [
        milestone("late", day(-10), day(-6), "done"), milestone("early", day(-3), day(-9), "done"), milestone("over", day(-8)), milestone("heir", day(5)),
        milestone("grandchild", day(9)), milestone("shield", day(-2), day(-2), "done"), milestone("behind", day(3)), milestone("unfinished", day(-1), None, "done"),
    ]
    deps = [("heir", "late"), ("grandchild", "heir"), ("shield", "over"), ("behind", "shield"), ("heir", "early")]
    assert slips(spark, rows, deps) == {"late": 4, "early": -6, "over": 8, "heir": 4, "grandchild": 4, "shield": 0, "behind": 0, "unfinished": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_equal_a_walk_in_order(spark, seed):
    draw = random.Random(seed)
    n = 60
    rows = []
    for i in range(n):
        done = draw.random() < 0.3
        rows.append(milestone(f"m{i:02d}", day(draw.randrange(-30, 30)), day(draw.randrange(-30, 0)) if done else None, "done" if done else "planned"))
    deps = [(f"m{i:02d}", f"m{draw.randrange(i):02d}") for i in range(1, n) for _ in range(draw.randrange(0, 3))]
    want: dict[str, int] = {}
    for key, _, _, _, _, end, actual, status in rows:
        inherited = max([max(0, want[p]) for k, p in deps if k == key], default=0)
        want[key] = (actual - end).days if status == "done" else (max(end + timedelta(days=inherited), AS_OF) - end).days
    assert slips(spark, rows, deps) == want
    levels = {r["milestone_key"]: r["level"] for r in graph.topological_levels(*tables(spark, rows, deps)).collect()}
    assert len(levels) == n and all(levels[k] > levels[p] for k, p in deps)


def test_cycles_and_unknown_names_raise(spark):
    rows = [milestone("a", day(1)), milestone("b", day(1)), milestone("c", day(1))]
    with pytest.raises(graph.DependencyCycle, match=r"\['a', 'b'\]"):
        graph.plan(*tables(spark, rows, [("a", "b"), ("b", "a")]), AS_OF)
    with pytest.raises(graph.UnknownDependency, match="'x'"):
        graph.plan(*tables(spark, rows, [("a", "x")]), AS_OF)
    with pytest.raises(ValueError, match="no planned_end"):
        graph.plan(*tables(spark, [milestone("a", None)], []), AS_OF)
    assert graph.plan(*tables(spark, [], []), AS_OF).isEmpty()


def rounds_of(monkeypatch):
    """How often a table was written since."""
    calls = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: calls.append(1) or cut(df))
    return calls


def test_a_chain_of_ten_thousand_links(spark, monkeypatch):
    n = 10_001
    rows = spark.range(n).selectExpr("format_string('m%05d', id) AS milestone_key", "'n' AS name", "'a' AS account_name", "'o' AS owner_email", "DATE '2026-01-01' AS planned_start",
        "date_sub(DATE '2026-04-20', CASE WHEN id = 0 THEN 9 WHEN id = 5000 THEN 30 ELSE -400 END) AS planned_end", "CAST(NULL AS DATE) AS actual_end", "'planned' AS status")
    deps = spark.range(1, n).selectExpr("format_string('m%05d', id) AS milestone_key", "format_string('m%05d', id - 1) AS depends_on_key")
    calls = rounds_of(monkeypatch)
    levels = {r["milestone_key"]: r["level"] for r in graph.topological_levels(rows, deps).collect()}
    assert levels == {f"m{i:05d}": i for i in range(n)} and len(calls) < 2 * 20
    calls.clear()
    slip = {r["milestone_key"]: r["slip_days"] for r in graph.plan(rows, deps, AS_OF, check=False).collect()}
    assert slip == {f"m{i:05d}": 9 if i < 5000 else 30 for i in range(n)} and len(calls) < 2 * 20


def test_paths_of_a_ladder_a_fan_and_a_wide_graph(spark, monkeypatch):
    """Two lanes with rungs (rounds by the logarithm), a node below 500 others, and layers too wide to draw all longer links."""
    ladder = [(f"l{i}{a}", f"l{i + 1}{b}", i % 3) for i in range(300) for a in "xy" for b in "xy" if a == b or i % 2]
    fan = [(f"f{i}", "foot", i) for i in range(500)] + [("top", f"f{i}", 0) for i in range(500)]
    draw = random.Random(4)
    wide = [(f"w{d:02d}_{draw.randrange(40)}", f"w{d + 1:02d}_{i}", draw.randrange(5)) for d in range(12) for i in range(40) for _ in range(6)]
    for links, most in ((ladder, 14), (fan, 4), (wide, 13)):
        nodes = sorted({n for a, b, _ in links for n in (a, b)})
        own = {n: draw.randrange(20) if draw.random() < 0.9 else None for n in nodes}
        calls = rounds_of(monkeypatch)
        got = {r["node"]: r["value"] for r in graph.greatest_over_paths(
            spark.createDataFrame(list(own.items()), "node string, value int"), spark.createDataFrame(links, "above string, below string, weight int")).collect()}
        above = {}
        for a, b, w in links:
            above.setdefault(b, []).append((a, w))
        want = {}

        def value(n):
            if n not in want:
                found = [own[n], *(value(a) + w for a, w in above.get(n, []) if value(a) is not None)]
                want[n] = max((v for v in found if v is not None), default=None)
            return want[n]

        order = sorted(nodes, key=lambda n: (n[0], int(n[1:-1]) if n[0] == "l" else 0, n))
        assert got == {n: value(n) for n in order}
        assert len(calls) <= 2 * (most + 1)


def test_what_lies_below_a_cycle_is_stuck(spark):
    deps = [("c", "a"), ("a", "b"), ("b", "c"), ("d", "c"), ("d", "free"), ("x", "free"), ("self", "self")]
    keys = spark.createDataFrame([(k,) for k in sorted({k for d in deps for k in d})], "milestone_key string")
    with pytest.raises(graph.DependencyCycle) as caught:
        graph.topological_levels(keys, spark.createDataFrame(deps, TABLES["milestone_deps"]))
    assert sorted(r[0] for r in caught.value.stuck.collect()) == ["a", "b", "c", "d", "self"] and "['a', 'b', 'c', 'd', 'self']" in str(caught.value)


def found(spark, rows, deps=(), tickets=(), config=None):
    milestones, edges = tables(spark, rows, list(deps))
    plan = graph.plan(milestones, edges, AS_OF)
    board = spark.createDataFrame(list(tickets), TICKETS)
    return plan, rules.evaluate(plan, edges, board, AS_OF, config), board


def fired(escalations):
    return {(r["rule_id"], r["milestone_key"], r["subject_key"]) for r in escalations.collect()}


def test_each_rule_fires_and_stays_silent(spark):
    rows = [
        milestone("over", day(-1)), milestone("today", day(0)), milestone("done", day(-9), day(-1), "done", ""), milestone("p3", day(-5), day(-2), "done"),
        milestone("p4", day(-5), day(-1), "done"), milestone("c3", day(30)), milestone("c4", day(30)), milestone("bare7", day(7), owner=""), milestone("bare8", day(8), owner=""),
        milestone("bare0", day(0), owner=""),
    ]
    tickets = [
        ("t1", "today", "open", True, day(-1)), ("t2", "today", "open", True, day(0)), ("t3", "today", "done", False, day(-1)), ("t4", "today", "open", True, None),
        ("t5", "done", "open", True, day(-1)), ("t6", "", "open", True, day(-1)),
    ]
    _, got, _ = found(spark, rows, [("c3", "p3"), ("c4", "p4")], tickets)
    assert fired(got) == {
        ("milestone_overdue", "over", ""), ("blocking_ticket_overdue", "today", "t1"), ("dependency_slip", "c4", "p4"), ("projected_late", "c3", ""), ("projected_late", "c4", ""),
        ("unowned_milestone", "bare7", ""), ("unowned_milestone", "bare0", ""),
    }
    _, got, _ = found(spark, rows, [("c3", "p3")], (), rules.RuleConfig(slip_tolerance_days=2, unowned_within_days=8))
    assert ("dependency_slip", "c3", "p3") in fired(got) and ("unowned_milestone", "bare8", "") in fired(got)


def test_recording_twice_adds_nothing(spark):
    _, got, _ = found(spark, [milestone("over", day(-1))], (), [("t1", "over", "open", True, day(-1)), ("t2", "over", "open", True, day(-1))])
    old = spark.createDataFrame([], TABLES["escalations"])
    every, new = rules.record(old, got, AS_OF, datetime(2026, 4, 20))
    assert new.count() == 3
    every, new = rules.record(every, got, AS_OF, datetime(2026, 4, 21))
    assert new.isEmpty() and every.count() == 3
    _, new = rules.record(every, got, day(1), datetime(2026, 4, 21))
    assert new.count() == 3


def test_report(spark):
    plan, got, board = found(spark, [milestone("M1", day(-10), day(-6), "done"), milestone("M2", day(5), owner="")], [("M2", "M1")], [("T1", "M2", "open", True, day(-1))])
    lines = report.report_lines(plan, got, metrics.ticket_counts(board), AS_OF)
    text = report.render(lines)
    assert text == report.render(lines.repartition(7))
    head, *rest = text.split("\n")
    assert head == "=" * 84 and rest[0] == "PROJECT MILESTONE REPORT (synthetic data)   as of 2026-04-20"
    assert "M1         2026-04-10  2026-04-14  2026-04-14  +4d late        0/0       done" in rest
    assert "M2         2026-04-25  -           2026-04-29  +4d projected   1/1       planned" in rest
    assert "           depends on: M1" in rest and "ESCALATIONS: 4" in rest
    assert rest.index("  HIGH    M2 [T1]  blocking_ticket_overdue") < rest.index("  HIGH    M2 [M1]  dependency_slip") < rest.index("  MEDIUM  M2  projected_late")
    plan, got, board = found(spark, [milestone("M1", day(10))])
    assert "ESCALATIONS: none. Every open milestone is on track as of this date." in report.render(report.report_lines(plan, got, metrics.ticket_counts(board), AS_OF))


def test_milestones_are_replaced_and_dependencies_added(spark):
    old, deps = tables(spark, [milestone("a", day(1)), milestone("b", day(1))], [("b", "a")])
    given = spark.createDataFrame([(*milestone("b", day(9)), []), (*milestone("c", day(2)), ["a", "a"])], TABLES["milestones"] + ", depends_on array<string>")
    rows, edges = merge_milestones(old, deps, given)
    assert sorted((r["milestone_key"], r["planned_end"]) for r in rows.collect()) == [("a", day(1)), ("b", day(9)), ("c", day(2))]
    assert sorted(map(tuple, edges.collect())) == [("b", "a"), ("c", "a")]
