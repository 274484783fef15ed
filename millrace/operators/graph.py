"""Milestones that depend on each other: order, cycles, and slip handed down to what is still open.

Slip of a finished milestone is its own; of an open one it is the greatest of zero, of the days it is overdue, and of
the slip of every milestone that it depends on. Levels are the same with one more for each link. Both are the greatest
value over all paths that end in a milestone, found by contraction: in each round every link hands on what its upper
end has, and is then drawn from the links above that end, so that it spans twice the distance.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import cut, drop

DONE, PLANNED = "done", "planned"
#: Milestones of a cycle that an error names.
NAMED = 20
#: Links are replaced by up to MANY longer ones each while there are no more than GROWTH times as many as were given.
MANY, GROWTH = 64, 8


class UnknownDependency(ValueError):
    """A dependency names a milestone that is not there."""


class DependencyCycle(ValueError):
    """Some milestones depend on themselves. stuck: milestone_key of all that cannot be levelled; the text names the first of them."""

    def __init__(self, text: str, stuck: DataFrame) -> None:
        super().__init__(text)
        self.stuck = stuck


def greatest_over_paths(values: DataFrame, links: DataFrame) -> DataFrame:
    """node, value: the greatest value + weights of any path that ends in the node; its own is a path, too.

    values: node, value (null where it has none); links: above, below, weight, of nodes that are all in values. In a round every
    link offers its lower end what its upper end has. It is then replaced by the links above its upper end, each
    longer by it, if these are few: none (it is done with), one, or as many as leave all links within GROWTH times the given
    ones. So runs of single links, and graphs that are narrow at every depth, take rounds by the logarithm of their
    longest path; at worst there is a round for each link of it. Links left with no upper end free of links are
    below a cycle: DependencyCycle.
    """
    values, links = _cut_together(values.select("node", "value"), links.select("above", "below", "weight").distinct())
    most = GROWTH * links.count()
    while True:
        ins = links.groupBy(F.col("below").alias("above")).agg(F.count("*").alias("ins"))
        known = links.join(ins, "above", "left").withColumn("ins", F.coalesce("ins", F.lit(0)))
        sized = {r["ins"]: r["n"] for r in known.groupBy(F.least("ins", F.lit(MANY + 1)).alias("ins")).agg(F.count("*").alias("n")).collect()}
        if not sized:
            return values
        if 0 not in sized:
            raise _cycle(links.select(F.col("below").alias("milestone_key")).distinct())
        few = _few(sized, most)
        offers = links.join(values, values["node"] == links["above"]).groupBy(F.col("below").alias("node")).agg(F.max(F.col("value") + F.col("weight")).alias("offer"))
        better = values.join(offers, "node", "left").select("node", F.greatest("value", "offer").alias("value"))
        upper = links.select(F.col("below").alias("middle"), F.col("above").alias("top"), F.col("weight").alias("more"))
        moved = (
            known.filter(F.col("ins").between(1, few)).join(upper, F.col("above") == F.col("middle"))
            .select(F.col("top").alias("above"), "below", (F.col("weight") + F.col("more")).alias("weight"))
        )
        kept = known.filter(F.col("ins") > few).select("above", "below", "weight")
        longer = moved.unionByName(kept).groupBy("above", "below").agg(F.max("weight").alias("weight"))
        before = values, links
        values, links = _cut_together(better, longer)
        for table in before:
            drop(table)


def _cut_together(*tables: DataFrame) -> list[DataFrame]:
    """Each of the tables cut, in jobs that run side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(cut, tables))


def _few(sized: dict[int, int], most: int) -> int:
    """Links are replaced by those above them if these are at most so many; sized: how many links have 0 to MANY (and more) above them."""
    few = 1
    while few < MANY:
        grown = sum(n * (ins if ins <= 2 * few else 1) for ins, n in sized.items())
        if grown > most:
            break
        few *= 2
    return few


def _cycle(stuck: DataFrame) -> DependencyCycle:
    named = [r["milestone_key"] for r in stuck.orderBy("milestone_key").limit(NAMED).collect()]
    more = stuck.count() - len(named)
    return DependencyCycle(f"cycle among milestones {named}" + (f" and {more} more" if more else ""), stuck)


def topological_levels(keys: DataFrame, deps: DataFrame) -> DataFrame:
    """milestone_key, level: zero without dependencies, else one more than the highest of them. Raises for cycles and unknown names.

    keys: milestone_key; deps: milestone_key, depends_on_key. Sorting by level and key is an order in which every
    milestone comes after what it depends on.
    """
    keys, deps = keys.select("milestone_key").distinct(), cut(deps.select("milestone_key", "depends_on_key").distinct())
    missing = deps.join(keys.withColumnRenamed("milestone_key", "depends_on_key"), "depends_on_key", "left_anti")
    if first := missing.orderBy("milestone_key", "depends_on_key").first():
        raise UnknownDependency(f"{first['milestone_key']!r} depends on unknown milestone {first['depends_on_key']!r}")
    links = deps.select(F.col("depends_on_key").alias("above"), F.col("milestone_key").alias("below"), F.lit(1).alias("weight"))
    return greatest_over_paths(keys.select(F.col("milestone_key").alias("node"), F.lit(0).alias("value")), links).select(F.col("node").alias("milestone_key"), F.col("value").alias("level"))


def plan(milestones: DataFrame, deps: DataFrame, as_of: date, check: bool = True) -> DataFrame:
    """milestones with depends_on, inherited_slip_days, slip_days, projected_end, is_done, is_overdue and is_at_risk.

    With ``check`` the graph is searched for cycles and unknown names first, and a milestone without planned_end is
    refused; without it such milestones have no slip, and only a cycle of open milestones is an error. A milestone is done if its status says so and it has an
    actual_end. Sort by planned_end and milestone_key for the schedule.
    """
    if check:
        topological_levels(milestones, deps)
        if bad := milestones.filter("planned_end is null").orderBy("milestone_key").first():
            raise ValueError(f"milestone {bad['milestone_key']!r} has no planned_end")
    today = F.lit(as_of).cast("date")
    done = (F.col("status") == DONE) & F.col("actual_end").isNotNull()
    base = F.when(done, F.date_diff("actual_end", "planned_end")).otherwise(F.greatest(F.lit(0), F.date_diff(today, F.col("planned_end"))))
    rows = milestones.withColumn("is_done", F.coalesce(done, F.lit(False)))
    edges = cut(deps.select("milestone_key", "depends_on_key").distinct())
    down = edges.join(rows.filter("not is_done").select("milestone_key"), "milestone_key").join(rows.select(F.col("milestone_key").alias("depends_on_key")), "depends_on_key", "left_semi")
    links = down.select(F.col("depends_on_key").alias("above"), F.col("milestone_key").alias("below"), F.lit(0).alias("weight"))
    best = greatest_over_paths(rows.select(F.col("milestone_key").alias("node"), base.alias("value")), links).select(F.col("node").alias("milestone_key"), F.col("value").alias("slip"))
    above = (
        edges.join(best.select(F.col("milestone_key").alias("depends_on_key"), "slip"), "depends_on_key", "left")
        .groupBy("milestone_key").agg(F.greatest(F.lit(0), F.max("slip")).alias("inherited_slip_days"), F.sort_array(F.collect_list("depends_on_key")).alias("depends_on"))
    )
    none = F.array().cast("array<string>")
    return (
        rows.join(best.select("milestone_key", F.col("slip").alias("slip_days")), "milestone_key").join(above, "milestone_key", "left")
        .withColumn("depends_on", F.coalesce("depends_on", none)).fillna(0, ["inherited_slip_days"])
        .withColumn("projected_end", F.date_add("planned_end", F.col("slip_days")))
        .withColumn("is_overdue", ~F.col("is_done") & (F.col("planned_end") < today))
        .withColumn("is_at_risk", F.col("slip_days") > 0)
    )
