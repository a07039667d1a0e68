"""Connected components of an edge table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table of longs;
    the component is its smallest node.

    Each round hooks every node to its smallest neighbour (or itself), follows
    two more hooks, and relabels the edges, which drops those that became
    loops; rounds end when no edge is left. Rounds are cut by tables in the
    session's checkpoint folder.
    """
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                       .where("a <> b").distinct(), as_table=True)
    label = None
    while not left.isEmpty():
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hook = materialize(hook, as_table=True)
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hook = materialize(hook, as_table=True)
        if label is None:
            label = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            label = label.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = materialize(label, as_table=True)
        to_a, to_b = (hook.select(F.col("node").alias(c), F.col("up").alias(f"new_{c}")) for c in ("a", "b"))
        left = materialize(left.join(to_a, "a").join(to_b, "b")
                           .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
                           .where("a <> b").distinct(), as_table=True)
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return label
