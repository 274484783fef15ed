"""Connected components by repeated contraction: every node joins its best neighbour, then edges are drawn between the joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root: one row per node that has an edge; equal roots mean connected. edges: a, b (long).

    Nodes are ranked by a hash, so that chains shrink by a constant factor in each round whatever their numbering; the
    root is any node of the component. Loops and repeated edges do no harm. Each round is written before the next.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        best = ends.groupBy("node").agg(F.min(rank("other")).alias("best"))
        joined = cut(best.select("node", F.least("best", rank("node"))["v"].alias("to")))
        rounds.append(joined)
        edges = (
            edges.join(joined.select(F.col("node").alias("a"), F.col("to").alias("c")), "a")
            .join(joined.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
            .filter("c <> d")
            .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))
            .distinct()
        )
        edges = cut(edges)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1].select("node", F.col("to").alias("root"))
    for earlier in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = earlier.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
