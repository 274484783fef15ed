"""Rows in an order that can be seen: sorted by ranges, and numbered without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.lineage import cut

#: How the tables are read in order. All columns together tell the rows of a table apart.
READ_ORDER = {
    "contacts": ("email",), "accounts": ("name",), "activities": ("source", "natural_key"), "ledger": ("source", "natural_key"), "cursors": ("source",),
    "audit": ("at", "source", "natural_key", "action", "new_hash", "detail"), "dead_letter": ("source", "natural_key"), "milestones": ("planned_end", "milestone_key"),
    "milestone_deps": ("milestone_key", "depends_on_key"), "escalations": ("as_of", "milestone_key", "rule_id", "subject_key"), "tickets": ("ticket_key",), "deals": ("deal_id",),
}


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with the place of each row in the order, from zero. Rows that tie are numbered as they come.

    The rows are dealt out by ranges and sorted in their tasks; only how many each task has is summed up over all.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    own = (1 << 33) - 1  # the part of a monotonically increasing id that counts within a task
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    dealt = cut(dealt.withColumns({"_id": F.monotonically_increasing_id()}).withColumns({"_task": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit(own))}))
    sizes = dealt.groupBy("_task").agg(F.count("*").alias("_size"))  # a row for each task
    before = sizes.select("_task", (F.sum("_size").over(Window.orderBy("_task")) - F.col("_size")).alias("_before"))
    return dealt.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + F.col("_nth")).drop("_id", "_task", "_nth", "_before")


def in_order(table: str, df: DataFrame, **equal: object) -> DataFrame:
    """Rows of a table with these values (null finds null), sorted as the table is read; a filter on stored columns reaches the scan."""
    for column, value in equal.items():
        df = df.filter(F.col(column).eqNullSafe(F.lit(value)))
    return df.orderBy(*READ_ORDER[table])
