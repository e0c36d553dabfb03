"""Depths in trees of any depth by pointer doubling: a path of n nodes takes about log2(n) joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import stage, unstage


def tree_depths(edges: DataFrame) -> DataFrame:
    """GR6, G5: (node, root, depth) of (child, parent) edges: depth 1 for a root, one more for each level.

    Each round a node looks to the ancestor of its ancestor, twice as far as before. Nodes on a cycle or below one have no root: their root and depth
    are null, told when rounds enough for all nodes have passed. Of several parents the least counts; edges without child or
    parent are left out; repeated edges count once.
    """
    known = edges.where("child IS NOT NULL AND parent IS NOT NULL").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    first = stage(known.withColumn("far", F.lit(1).cast("long")), "parents")
    roots = first.select(F.col("up").alias("node")).distinct().join(first.select("node"), "node", "left_anti")
    # done: the ancestor that is looked to is a root.
    top = roots.select(F.col("node").alias("up"), F.lit(True).alias("_root"))
    state = stage(first.join(top, "up", "left").select("node", "up", "far", F.coalesce("_root", F.lit(False)).alias("done")), "ancestors")
    for _ in range(first.count().bit_length() + 1):
        if state.where("NOT done").isEmpty():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(ahead, "up").select("node", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        before, state = state, stage(state.where("done").unionByName(moved), "ancestors")
        unstage(before)
    below = state.select("node", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("far") + 1).alias("depth"))
    return roots.select("node", F.col("node").alias("root"), F.lit(1).cast("long").alias("depth")).unionByName(below)
