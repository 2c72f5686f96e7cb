"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): every node that an edge names, with the smallest node it is connected to.

    In each round every node takes the smallest label around it, labels jump to
    the label of their label, and the edges are drawn again between the labels;
    edges within a label fall away. What is left shrinks from round to round,
    and no round holds a node's neighbours together: they are rows, whose
    minimum is taken partly before the shuffle. The state is written after each
    round. Null ends are left out, loops only name their node.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    left = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    for _ in range(most_rounds):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        # Two jumps: chains of hooks shrink to a quarter before the edges are drawn again.
        hook = cut(hook)
        for _ in range(2):
            far = cut(hook.join(hook.toDF("to", "beyond"), "to").select("node", F.col("beyond").alias("to")))
            forget(hook)
            hook = far
        if label is None:
            label = hook
        else:
            moved = label.join(hook.toDF("to", "beyond"), "to", "left")
            after = cut(moved.select("node", F.coalesce("beyond", "to").alias("to")))
            forget(label)
            label = after
        ends = left.join(hook.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(hook.withColumnsRenamed({"node": "b", "to": "y"}), "b").where("x <> y")
        drawn = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        forget(left)
        left = drawn
        if left.isEmpty():
            return label.select("node", F.col("to").alias("component"))
    raise RuntimeError("labels still travel after the most rounds allowed")
