"""Connected components by repeated contraction, in DataFrame operations.

Each round hooks every node to its smallest neighbour, follows that pointer once more, and keeps
the distinct edges between different pointers. A round at least halves the nodes that still have
edges, so the number of rounds grows with the logarithm of the largest component. The smallest
node of a component never moves and so names it.

All tables between rounds are written stages: nothing of them reaches the driver, a lost executor
costs one round's tasks, and joins between two stages are of the form whose skewed partitions Spark
splits at run time, so a hub node does not hold up one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.session import write_stage


def _pointed(nodes: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by what it points at, where it does."""
    to = pointers.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    return nodes.join(to, F.col(column) == F.col("_node"), "left").withColumn(
        column, F.coalesce("_parent", column)).drop("_node", "_parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; component is its smallest node.

    Direction, repeats and self-loops do not matter; edges with a null end are ignored. Nodes whose
    only edges are self-loops are not returned, and an empty table gives an empty result.
    """
    level = write_stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    empty = level.select(F.col("a").alias("node"), F.col("a").alias("component"))
    rounds: list[DataFrame] = []
    while not level.isEmpty():
        ends = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = write_stage(ends.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("node")).alias("parent")), "hooked")
        pointers = write_stage(_pointed(hooked, hooked, "parent"), "pointers")
        rounds.append(pointers)
        moved = _pointed(_pointed(level, pointers, "a"), pointers, "b").filter("a <> b")
        level = write_stage(moved.distinct(), "edges")
    if not rounds:
        return empty
    out = rounds[-1]
    for pointers in reversed(rounds[:-1]):
        out = write_stage(_pointed(pointers, out, "parent"), "resolved")
    return out.select("node", F.col("parent").alias("component"))
