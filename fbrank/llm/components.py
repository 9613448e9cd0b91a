"""Connected components of an edge list, all in DataFrame joins.

Each round every node points to its smallest neighbour (or itself), pointers are followed by
doubling until they end in local minima, and the edges are renamed to those minima; edges inside
one tree vanish.  At least half of the nodes that still have edges go in each round.  Star-shaped
input, which the near-duplicate kernels emit, ends after one round.

Every table that a join meets has been checkpointed, so that both sides of the join are plain
shuffles and adaptive execution can split the hot key of a large component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import settled


def _edges(df: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return settled(df.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` pairs to ``(node, component)``: the smallest node reachable, itself included.

    Nodes without an edge to another node are not listed; null ends are ignored."""
    e = _edges(edges.select("a", "b").dropna())
    labels = e.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            e.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = settled(both.groupBy("node").agg(F.min("near").alias("near"))
                     .select("node", F.least("node", "near").alias("up")))
        moving = True
        while moving:
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            step = settled(up.join(far, "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
            up, moving = step.select("node", "up"), not step.filter("moved").isEmpty()
        end_a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        end_b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        e = _edges(e.join(end_a, "a").join(end_b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")))
        if first:
            labels, first = up.select("node", F.col("up").alias("component")), False
        else:
            to = up.select(F.col("node").alias("component"), "up")
            labels = settled(labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
    return labels


def smallest_reachable(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Inside one kernel group: per row the smallest id of its component in a symmetric link matrix."""
    root = np.full(len(ids), -1, np.int64)
    for s in np.argsort(ids, kind="stable"):
        if root[s] < 0:
            seen = np.zeros(len(ids), bool)
            seen[s] = True
            front = np.array([s])
            while len(front):
                new = link[front].any(axis=0) & ~seen
                seen |= new
                front = np.nonzero(new)[0]
            root[seen] = s
    return ids[root]
