"""Queries over the milestone plan: each customer's orders are a chain of milestones, their lines the tickets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.lineage import cut
from millrace.model import TABLES
from millrace.operators import graph, metrics, report, rules
from millrace.operators.order import READ_ORDER, numbered
from millrace.operators.projections import merge_milestones
from millrace.plans.events import table
from millrace.sources.files import json_rows, parse_milestones

AS_OF = date(2001, 6, 1)


def _milestones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as milestones (done where the status is F and there is a line), and their dependencies on the customer's order before."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("shipped"))
    orders = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    done, key = F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")
    owner = F.when(F.col("o_orderpriority").startswith("4"), "").otherwise(F.concat(F.lit("owner"), F.col("o_custkey").cast("string"), F.lit("@example.com")))
    rows = orders.select(
        key.alias("milestone_key"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("account_name"), owner.alias("owner_email"),
        F.col("o_orderdate").cast("date").alias("planned_start"), F.col("o_orderdate").cast("date").alias("planned_end"),
        F.when(done, F.col("shipped")).alias("actual_end"), F.when(done, "done").otherwise("planned").alias("status"),
    )
    before = F.lag(key).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    deps = table(spark, sf_dir, "orders").select(key.alias("milestone_key"), before.alias("depends_on_key")).filter("depends_on_key is not null")
    return cut(rows), cut(deps)


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(order, F.lit("-"), F.col("l_linenumber").cast("string")).alias("ticket_key"), order.alias("milestone_key"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("done").alias("status"), (F.col("l_linestatus") == "O").alias("is_open"),
        F.col("l_shipdate").cast("date").alias("due_date"),
    )


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    milestones, deps = _milestones(spark, sf_dir)
    return cut(graph.plan(milestones, deps, AS_OF, check=False)), deps  # chains by construction


def milestone_slip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan(spark, sf_dir)
    return plan.select(
        "milestone_key", "is_done", "is_overdue", "is_at_risk", "slip_days", "inherited_slip_days", F.date_format("projected_end", "yyyy-MM-dd").alias("projected_end"),
        report.slip_label(F.col("is_done"), F.col("slip_days")).alias("slip"),
    )


def milestone_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    milestones, deps = _milestones(spark, sf_dir)
    return graph.topological_levels(milestones, deps)


def milestone_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan loaded over an older one of the same orders: rows are replaced, dependencies only added."""
    milestones, deps = _milestones(spark, sf_dir)
    listed = deps.groupBy("milestone_key").agg(F.collect_list("depends_on_key").alias("depends_on"))
    new = milestones.filter("status = 'done'").withColumn("name", F.lit("new")).join(listed, "milestone_key", "left")
    rows, edges = merge_milestones(milestones, deps, new)
    return rows.join(edges.groupBy("milestone_key").agg(F.count("*").alias("n_deps")), "milestone_key", "left").select("milestone_key", "name", "status", F.coalesce("n_deps", F.lit(0)).alias("n_deps"))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plan, deps = _plan(spark, sf_dir)
    return plan, rules.evaluate(plan, deps, _tickets(spark, sf_dir), AS_OF)


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


def escalation_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many escalations are new by rule: those of high severity were recorded before."""
    found, now = cut(_found(spark, sf_dir)[1]), datetime(2001, 6, 1)
    known, _ = rules.record(spark.createDataFrame([], TABLES["escalations"]), found.filter("rank = 0"), AS_OF, now)
    every, new = rules.record(cut(known), found, AS_OF, now)
    count = lambda df, name: df.groupBy("rule_id").agg(F.count("*").alias(name))
    return count(every, "recorded").join(count(new, "new"), "rule_id", "left").fillna(0, ["new"])


def milestone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, found = _found(spark, sf_dir)
    lines = report.report_lines(plan, cut(found), metrics.ticket_counts(_tickets(spark, sf_dir)), AS_OF)
    return lines.filter("section in (1, 3)").select("section", "key", "rule_id", "subject_key", "part", F.rtrim("line").alias("line"))


def schedule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The milestones in the order of the schedule, with their places."""
    rows = _milestones(spark, sf_dir)[0].select("milestone_key", F.date_format("planned_end", "yyyy-MM-dd").alias("planned_end"))
    return numbered(rows, *READ_ORDER["milestones"])


def escalations_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The escalations as they are reported: by severity, milestone, rule and subject."""
    found = _found(spark, sf_dir)[1]
    return numbered(found.select("rank", "milestone_key", "rule_id", "subject_key"), "rank", "milestone_key", "rule_id", "subject_key")


def escalations_by_other_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with a wider tolerance and a longer look ahead."""
    plan, deps = _plan(spark, sf_dir)
    return rules.evaluate(plan, deps, _tickets(spark, sf_dir), AS_OF, rules.RuleConfig(slip_tolerance_days=40, unowned_within_days=30))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, its lines numbered as they are read."""
    plan, found = _found(spark, sf_dir)
    lines = report.report_lines(plan, cut(found), metrics.ticket_counts(_tickets(spark, sf_dir)), AS_OF)
    return numbered(lines, *report.ORDER, "line").select("pos", "section", F.rtrim("line").alias("line"))


def milestone_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The milestones of each customer as a JSON array, read and merged into an empty plan."""
    milestones, deps = _milestones(spark, sf_dir)
    listed = deps.groupBy("milestone_key").agg(F.collect_list("depends_on_key").alias("depends_on"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(" ")).alias(c)
    row = F.to_json(F.struct("milestone_key", "name", "owner_email", day("planned_end"), day("actual_end"), "status", "depends_on"))
    texts = milestones.join(listed, "milestone_key", "left").groupBy("account_name").agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value"))
    rows, edges = merge_milestones(*[spark.createDataFrame([], TABLES[n]) for n in ("milestones", "milestone_deps")], parse_milestones(json_rows(texts)))
    counted = edges.groupBy("milestone_key").agg(F.min("depends_on_key").alias("parent"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.join(counted, "milestone_key", "left").select("milestone_key", "name", "account_name", "owner_email", text("planned_end"), text("actual_end"), "status", "parent")


def ticket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ticket_counts(_tickets(spark, sf_dir))


QUERIES = {
    "milestone_slip": milestone_slip,
    "milestone_levels": milestone_levels,
    "milestone_upsert": milestone_upsert,
    "escalations": escalations,
    "escalation_insert_ignore": escalation_insert_ignore,
    "milestone_report": milestone_report,
    "ticket_counts": ticket_counts,
    "schedule_order": schedule_order,
    "escalations_in_order": escalations_in_order,
    "escalations_by_other_rules": escalations_by_other_rules,
    "report_text": report_text,
    "milestone_file": milestone_file,
}

_PLAN = """WITH RECURSIVE shipped AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY l_orderkey),
    m AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS name, CASE WHEN o_orderpriority LIKE '4%' THEN '' ELSE 'owner' || o_custkey || '@example.com' END AS owner,
                 CAST(o_orderdate AS DATE) AS planned, CASE WHEN o_orderstatus = 'F' THEN d END AS actual, o_orderstatus = 'F' AND d IS NOT NULL AS done, o_orderstatus,
                 CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS parent
          FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey),
    b AS (SELECT *, CASE WHEN done THEN actual - planned ELSE greatest(0, DATE '2001-06-01' - planned) END AS base FROM m),
    reach(k, slip) AS (SELECT k, base FROM b UNION SELECT c.k, r.slip FROM reach r JOIN b c ON c.parent = r.k AND NOT c.done),
    best AS (SELECT k, max(slip) AS slip FROM reach GROUP BY k),
    plan AS (SELECT b.*, CAST(best.slip AS INT) AS slip, CAST(greatest(0, coalesce(p.slip, 0)) AS INT) AS inherited, CAST(planned + CAST(best.slip AS INT) AS DATE) AS projected,
                    NOT done AND planned < DATE '2001-06-01' AS overdue, p.slip AS parent_slip
             FROM b JOIN best ON best.k = b.k LEFT JOIN best p ON p.k = b.parent),
    label AS (SELECT *, CASE WHEN done THEN CASE WHEN slip > 0 THEN '+' || slip || 'd late' WHEN slip < 0 THEN slip || 'd early' ELSE 'on time' END
                             WHEN slip > 0 THEN '+' || slip || 'd projected' ELSE 'on track' END AS said FROM plan),
    tix AS (SELECT l_orderkey || '-' || l_linenumber AS t, CAST(l_orderkey AS VARCHAR) AS k, CAST(l_shipdate AS DATE) AS due, l_linestatus = 'O' AS open FROM lineitem),
    found AS (
        SELECT 0 AS rank, 'milestone_overdue' AS rule_id, 'high' AS severity, k AS milestone_key, '' AS subject_key,
               'planned ' || planned || ', still open on 2001-06-01 (' || slip || 'd late)' AS detail FROM plan WHERE overdue
        UNION ALL SELECT 0, 'blocking_ticket_overdue', 'high', p.k, t, 'ticket ' || t || ' is open and was due ' || due || ' (' || (DATE '2001-06-01' - due) || 'd ago)'
               FROM plan p JOIN tix ON tix.k = p.k WHERE NOT done AND open AND due < DATE '2001-06-01'
        UNION ALL SELECT 0, 'dependency_slip', 'high', k, parent, 'depends on ' || parent || ', which has slipped ' || parent_slip || 'd (tolerance 3d)'
               FROM plan WHERE NOT done AND parent_slip > 3
        UNION ALL SELECT 1, 'projected_late', 'medium', k, '', 'planned ' || planned || ', projected ' || projected || ' (' || inherited || 'd inherited from upstream)'
               FROM plan WHERE NOT done AND NOT overdue AND projected > planned
        UNION ALL SELECT 2, 'unowned_milestone', 'low', k, '', 'due in ' || (planned - DATE '2001-06-01') || 'd with no owner assigned'
               FROM plan WHERE NOT done AND owner = '' AND planned - DATE '2001-06-01' BETWEEN 0 AND 7)"""
_COUNTS = "SELECT CAST(l_orderkey AS VARCHAR) AS milestone_key, count(*) FILTER (l_linestatus = 'O') AS open, count(*) AS total FROM lineitem GROUP BY l_orderkey"

ORACLE_SQL = {
    "milestone_slip": f"""{_PLAN}
        SELECT k AS milestone_key, done AS is_done, overdue AS is_overdue, slip > 0 AS is_at_risk, slip AS slip_days, inherited AS inherited_slip_days,
               CAST(projected AS VARCHAR) AS projected_end, said AS slip FROM label""",
    "milestone_levels": """
        SELECT CAST(o_orderkey AS VARCHAR) AS milestone_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS level FROM orders""",
    "milestone_upsert": f"""{_PLAN}
        SELECT k AS milestone_key, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE name END AS name, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'planned' END AS status,
               CAST(parent IS NOT NULL AS BIGINT) AS n_deps FROM m""",
    "escalations": f"{_PLAN} SELECT * FROM found",
    "escalation_insert_ignore": f"{_PLAN} SELECT rule_id, count(*) AS recorded, count(*) FILTER (rank > 0) AS new FROM (SELECT DISTINCT rank, rule_id, milestone_key, subject_key FROM found) GROUP BY rule_id",
    "milestone_report": f"""{_PLAN},
        counts AS ({_COUNTS}),
        cells AS (SELECT k, rpad(k, 10, ' ') || ' ' || rpad(CAST(planned AS VARCHAR), 11, ' ') || ' ' || rpad(coalesce(CAST(actual AS VARCHAR), '-'), 11, ' ') || ' '
                  || rpad(CAST(projected AS VARCHAR), 11, ' ') || ' ' || said || repeat(' ', greatest(0, 15 - length(said))) || ' ' || rpad(coalesce(open, 0) || '/' || coalesce(total, 0), 9, ' ') || ' '
                  || CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'planned' END AS line, name, parent FROM label LEFT JOIN counts ON milestone_key = k)
        SELECT 1 AS section, k AS key, '' AS rule_id, '' AS subject_key, 0 AS part, line FROM cells
        UNION ALL SELECT 1, k, '', '', 1, rtrim('           ' || name) FROM cells
        UNION ALL SELECT 1, k, '', '', 2, '           depends on: ' || parent FROM cells WHERE parent IS NOT NULL
        UNION ALL SELECT 3, milestone_key, rule_id, subject_key, 0, '  ' || rpad(upper(severity), 7, ' ') || ' ' || milestone_key
            || CASE WHEN subject_key <> '' THEN ' [' || subject_key || ']' ELSE '' END || '  ' || rule_id FROM found
        UNION ALL SELECT 3, milestone_key, rule_id, subject_key, 1, '          ' || detail FROM found""",
    "ticket_counts": _COUNTS,
    "schedule_order": """
        SELECT CAST(o_orderkey AS VARCHAR) AS milestone_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS planned_end,
               row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR)) - 1 AS pos FROM orders""",
    "escalations_in_order": f"""{_PLAN}
        SELECT rank, milestone_key, rule_id, subject_key, row_number() OVER (ORDER BY rank, milestone_key, rule_id, subject_key) - 1 AS pos FROM found""",
    "escalations_by_other_rules": f"""{_PLAN.replace("parent_slip > 3", "parent_slip > 40").replace("tolerance 3d", "tolerance 40d").replace("BETWEEN 0 AND 7", "BETWEEN 0 AND 30")} SELECT * FROM found""",
    "milestone_file": f"""{_PLAN}
        SELECT k AS milestone_key, name, '' AS account_name, owner AS owner_email, CAST(planned AS VARCHAR) AS planned_end, CAST(actual AS VARCHAR) AS actual_end,
               CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'planned' END AS status, parent FROM m""",
}
# the report with its frame, in the order in which it is read
_HEADS = "rpad('MILESTONE', 11, ' ') || rpad('PLANNED', 12, ' ') || rpad('ACTUAL', 12, ' ') || rpad('PROJECTED', 12, ' ') || rpad('SLIP', 16, ' ') || rpad('OPEN TIX', 10, ' ') || 'STATUS'"
_BODY = ORACLE_SQL["milestone_report"].replace(
    "name, parent FROM label", "name, parent, planned FROM label"
).replace("SELECT 1 AS section, k AS key, '' AS rule_id, '' AS subject_key, 0 AS part, line FROM cells", f"""
        , lines AS (SELECT 0 AS section, 0 AS rank, CAST(NULL AS DATE) AS due_at, '' AS key, '' AS rule_id, '' AS subject_key, CAST(i - 1 AS INT) AS part,
            CASE i WHEN 2 THEN 'PROJECT MILESTONE REPORT (synthetic data)   as of 2001-06-01' WHEN 4 THEN '' WHEN 5 THEN {_HEADS} WHEN 6 THEN repeat('-', 84) ELSE repeat('=', 84) END AS line FROM range(1, 7) t(i)
        UNION ALL SELECT 1, 0, planned, k, '', '', 0, line FROM cells""").replace(
    "UNION ALL SELECT 1, k, '', '', 1,", "UNION ALL SELECT 1, 0, planned, k, '', '', 1,").replace(
    "UNION ALL SELECT 1, k, '', '', 2,", "UNION ALL SELECT 1, 0, planned, k, '', '', 2,").replace(
    "UNION ALL SELECT 3, milestone_key,", "UNION ALL SELECT 3, rank, NULL, milestone_key,")
ORACLE_SQL["report_text"] = f"""{_BODY}
        UNION ALL SELECT 2, 0, NULL, '', '', '', CAST(i - 1 AS INT), CASE i WHEN 1 THEN '' WHEN 3 THEN (SELECT CASE WHEN count(*) > 0 THEN 'ESCALATIONS: ' || count(*)
            ELSE 'ESCALATIONS: none. Every open milestone is on track as of this date.' END FROM found) ELSE repeat('=', 84) END FROM range(1, 5) t(i)
        UNION ALL SELECT 4, 0, NULL, '', '', '', 0, repeat('=', 84) FROM (SELECT 1 FROM found LIMIT 1))
        SELECT row_number() OVER (ORDER BY section, rank, due_at NULLS FIRST, key, rule_id, subject_key, part, line) - 1 AS pos, section, rtrim(line) AS line FROM lines"""
