"""Connected components by randomised contraction, with DataFrame operations only.

In each round every node goes to the neighbour (or itself) with the least hash, whose order is new in each round, and
edges are kept between what nodes went to. Expected edges fall by a constant factor a round, chains included. Every
round is a checkpoint, so a lost executor costs one round. Hot nodes are met by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): all nodes of a component and no others share a root, which is its least node."""
    live = C.checkpoint(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    steps: list[DataFrame] = []
    while live.head(1):
        seed = F.lit(len(steps))
        h = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("v"))
        sides = live.select(F.col("a").alias("node"), F.least(h("a"), h("b")).alias("x")).union(live.select(F.col("b").alias("node"), F.least(h("a"), h("b")).alias("x")))
        step = C.checkpoint(sides.groupBy("node").agg(F.min("x").alias("x")).select("node", F.col("x.v").alias("goes")))
        steps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("goes").alias("ga")), step.select(F.col("node").alias("b"), F.col("goes").alias("gb"))
        live = C.checkpoint(live.join(left, "a").join(right, "b").where("ga != gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct())
    out = nodes.select("node", F.col("node").alias("at"))
    for step in steps:
        s = step.select(F.col("node").alias("at"), "goes")
        out = out.join(s, "at", "left").select("node", F.coalesce("goes", "at").alias("at"))
    out = C.checkpoint(out)
    least = out.groupBy("at").agg(F.min("node").alias("root"))
    return out.join(least, "at").select("node", "root")
