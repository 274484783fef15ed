"""The milestone report: lines with the keys that put them in order, made where the rows are."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 84
ORDER = ["section", "rank", "at", "key", "rule_id", "subject_key", "part"]


def slip_label(done: Column, days: Column) -> Column:
    """How a milestone stands, in words."""
    text = days.cast("string")
    late, early = F.concat(F.lit("+"), text, F.lit("d late")), F.concat(text, F.lit("d early"))
    finished = F.when(days > 0, late).when(days < 0, early).otherwise(F.lit("on time"))
    return F.when(done, finished).when(days > 0, F.concat(F.lit("+"), text, F.lit("d projected"))).otherwise(F.lit("on track"))


def _padded(c: Column | str, width: int) -> Column:
    c = F.lit(c) if isinstance(c, str) else c
    return F.concat(F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " ")), F.lit(" "))


def _lines(rows: DataFrame, section: int, keys: dict[str, Column], lines: list[Column]) -> DataFrame:
    """The lines of each row that are not null, numbered from zero, with the keys that order them."""
    default = {"rank": F.lit(0), "at": F.lit(None).cast("date"), "key": F.lit(""), "rule_id": F.lit(""), "subject_key": F.lit("")} | keys
    return rows.select(
        F.lit(section).alias("section"), *[c.alias(n) for n, c in default.items()], F.posexplode(F.array(*lines)).alias("part", "line")
    ).filter("line is not null")


def report_lines(plan: DataFrame, escalations: DataFrame, counts: DataFrame, as_of: date) -> DataFrame:
    """The report's lines; sort by ORDER to read them. plan, escalations and counts are what plan(), evaluate() and ticket_counts() give."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-"))
    thick, thin = F.lit("=" * WIDTH), F.lit("-" * WIDTH)
    one = plan.sparkSession.range(1)
    heads = [("MILESTONE", 10), ("PLANNED", 11), ("ACTUAL", 11), ("PROJECTED", 11), ("SLIP", 15), ("OPEN TIX", 9)]
    title = F.lit(f"PROJECT MILESTONE REPORT (synthetic data)   as of {as_of.isoformat()}")
    header = _lines(one, 0, {}, [thick, title, thick, F.lit(""), F.concat(*[_padded(n, w) for n, w in heads], F.lit("STATUS")), thin])
    counted = plan.join(counts, "milestone_key", "left").fillna(0, ["open", "total"])
    tickets = F.concat_ws("/", F.col("open").cast("string"), F.col("total").cast("string"))
    cells = [F.col("milestone_key"), day("planned_end"), day("actual_end"), day("projected_end"), slip_label(F.col("is_done"), F.col("slip_days")), tickets]
    indent = F.lit(" " * 11)
    body = _lines(
        counted, 1, {"at": F.col("planned_end"), "key": F.col("milestone_key")},
        [
            F.concat(*[_padded(c, w) for c, (_, w) in zip(cells, heads, strict=True)], "status"),
            F.concat(indent, "name"),
            F.when(F.size("depends_on") > 0, F.concat(indent, F.lit("depends on: "), F.array_join("depends_on", ", "))),
        ],
    )
    n = escalations.agg(F.count("*").alias("n"))
    some = F.col("n") > 0
    none = F.lit("ESCALATIONS: none. Every open milestone is on track as of this date.")
    middle = _lines(n, 2, {}, [F.lit(""), thick, F.when(some, F.concat(F.lit("ESCALATIONS: "), F.col("n").cast("string"))).otherwise(none), thick])
    subject = F.when(F.col("subject_key") != "", F.concat(F.lit(" ["), "subject_key", F.lit("]"))).otherwise(F.lit(""))
    risks = _lines(
        escalations, 3, {"rank": F.col("rank"), "key": F.col("milestone_key"), "rule_id": F.col("rule_id"), "subject_key": F.col("subject_key")},
        [F.concat(F.lit("  "), _padded(F.upper("severity"), 7), "milestone_key", subject, F.lit("  "), "rule_id"), F.concat(F.lit(" " * 10), "detail")],
    )
    footer = _lines(n, 4, {}, [F.when(some, thick)])
    return header.unionByName(body).unionByName(middle).unionByName(risks).unionByName(footer)


def render(lines: DataFrame) -> str:
    """The report as one text, for a plan that a person can read; write ``lines`` sorted for a larger one."""
    return "".join(f"{r['line']}\n" for r in lines.orderBy(*ORDER).select("line").toLocalIterator())
