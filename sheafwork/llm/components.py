"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: the least node of its component.

    Each round every node hooks to its least neighbour, if that is smaller, and
    then to that one's hook; then the edges are drawn between hooks, and those
    within one hook go.  So the edges shrink from round to round, a node with
    very many edges is no single task, and the hooks of all rounds, followed in
    order, lead to the least node.
    """
    left = common.written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(left.groupBy("a").agg(F.lit(0)).select(F.col("a").alias("node"), F.col("a").alias("up")))
        hooks = common.written(ends.groupBy("node").agg(F.min("up").alias("up")), "hooks")
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = common.written(hooks.join(above, "up").select("node", F.col("top").alias("up")), "hooks")
        rounds.append(jumped)
        low = jumped.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        high = jumped.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        drawn = left.join(low, "a").join(high, "b").where("ua <> ub")
        left = common.written(drawn.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col(a).alias("node"), F.col(b).alias("label")).limit(0)
    labels = rounds[0].withColumnRenamed("up", "label")
    for step in rounds[1:]:
        on = step.select(F.col("node").alias("label"), "up")
        labels = labels.join(on, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return common.written(labels, "labels")
