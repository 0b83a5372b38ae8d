"""Connected components of an edge table, by contraction in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace, tidy


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame | None:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is its component's least node.

    In each round a node hooks onto the least of its neighbours and itself, hooks are followed
    twice more (pointer jumping), and edges are contracted; rounds end when no edge is left. The
    driver sees only whether edges remain. Null for an empty edge table.
    """
    edges = work.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if edges.isEmpty():
        return None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, turn = nodes.withColumn("root", F.col("node")), 0
    while True:
        hooks = edges.select(F.col("b").alias("v"), F.col("a").alias("to")).groupBy("v").agg(F.min("to").alias("to"))
        hooks = work.put(hooks, f"{name}-hooks{turn}")
        for _ in range(2):
            onward = hooks.select(F.col("v").alias("w"), F.col("to").alias("then"))
            hooks = hooks.join(onward, F.col("to") == F.col("w"), "left").select("v", F.coalesce("then", "to").alias("to"))
        hooks = work.put(hooks, f"{name}-jumps{turn}")
        labels = work.put(labels.join(hooks, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-labels{turn}")
        ha, hb = (hooks.select(F.col("v").alias(f"v{x}"), F.col("to").alias(f"to{x}")) for x in "ab")
        moved = edges.join(ha, F.col("a") == F.col("va"), "left").join(hb, F.col("b") == F.col("vb"), "left").select(F.coalesce("toa", "a").alias("a"), F.coalesce("tob", "b").alias("b"))
        edges = work.put(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges{turn}")
        if edges.isEmpty():
            tidy(work.spark)
            return labels
        turn += 1
