"""Connected components of an edge table by rounds of hooking, pointer jumping and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import Scratch, materialize


def _roots(left: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, to): for each end of an edge the root of its tree, where each node points to its smallest neighbour.

    Two nodes that point to each other are the only possible circle; the smaller one is the root. Pointers are then
    doubled until none moves, so a chain of n nodes takes log2 n doublings.
    """
    ends = left.select(F.col("lo").alias("v"), F.col("hi").alias("n")).unionByName(left.select(F.col("hi").alias("v"), F.col("lo").alias("n")))
    hooks = scratch.table(ends.groupBy("v").agg(F.min("n").alias("to")))
    back = hooks.select(F.col("v").alias("to"), F.col("to").alias("again"))
    up = scratch.table(hooks.join(back, "to").select("v", F.when((F.col("again") == F.col("v")) & (F.col("v") < F.col("to")), F.col("v")).otherwise(F.col("to")).alias("to")))
    while True:
        far = up.select(F.col("v").alias("to"), F.col("to").alias("far"))
        up = scratch.table(up.join(far, "to").select("v", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("v", "to")


def connected(edges: DataFrame, one: str = "a", two: str = "b") -> DataFrame:
    """(node, comp) of every node with an edge to another; comp is the smallest node of its component.

    Every tree of a round becomes one node of the next. Each node joins at least one other, so a round leaves at most
    half of the nodes: log2 n rounds at most, of halving size. A node may have any number of edges: its neighbours are
    counted by partial sums, and joins are plain ones that Spark may split.
    """
    scratch = Scratch(edges.sparkSession, "components")
    lo, hi = F.least(one, two), F.greatest(one, two)
    left = scratch.table(edges.filter(F.col(one) != F.col(two)).select(lo.alias("lo"), hi.alias("hi")).distinct())
    levels: list[DataFrame] = []
    while not left.isEmpty():
        up = _roots(left, scratch)
        levels.append(up)
        moved = left.join(up.select(F.col("v").alias("lo"), F.col("to").alias("x")), "lo").join(up.select(F.col("v").alias("hi"), F.col("to").alias("y")), "hi")
        left = scratch.table(moved.filter("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    # From the last, smallest level back to the nodes themselves.
    found = levels.pop() if levels else left.select(F.col("lo").alias("v"), F.col("hi").alias("to"))
    for up in reversed(levels):
        above = found.select(F.col("v").alias("to"), F.col("to").alias("top"))
        found = scratch.table(up.join(above, "to", "left").select("v", F.coalesce("top", "to").alias("to")))
    least = scratch.table(found.groupBy("to").agg(F.min("v").alias("comp")))
    labels = materialize(found.join(least, "to").select(F.col("v").alias("node"), "comp"), "labels")
    scratch.remove()
    return labels
