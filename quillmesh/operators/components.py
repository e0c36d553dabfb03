"""Connected components by alternating large and small stars, each round staged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import stage, unstage

#: Edges that a task contracts at once, before the first round; once no more are left, one task ends the rounds.
EDGES = 1 << 20
#: Edges of a node up to which they may be gathered in a task.
CROWDED = 100_000


def least_linked(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that these edges connect each to)."""
    nodes, ids = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ids[: len(src)], ids[len(src) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (further := root[root] != root).any():
            root = np.where(further, root[root], root)


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: each run of EDGES in a task as stars, and a loop for each node that has one."""

    def run(batches):
        held: list = []

        def stars():
            src, dst = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            nodes, roots = least_linked(src, dst)
            below, loops = nodes != roots, np.unique(src[src == dst])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, loops])) for x in (nodes[below], roots[below])], names=["src", "dst"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return edges.mapInArrow(run, "src long, dst long")


def _large_star(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(edges, what they read): each node hangs on the least neighbour of the lesser end of its edges (src > dst; `size` of them).

    Nodes of more than CROWDED and a 500th of all edges, 1,000 at most, are looked up by a broadcast: their edges stay where they are.
    """
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = stage(both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")).select(F.col("src").alias("node"), F.least("src", "m").alias("m"), "n"), "least-linked")
    crowded = F.col("n") > max(CROWDED, size // 500)
    hubs = F.broadcast(least.where(crowded).select(F.col("node").alias("hub"), F.col("m").alias("hub_m")))
    told = edges.join(hubs, F.col("dst") == F.col("hub"), "left")
    few = told.where("hub IS NULL").join(least.where(~crowded), F.col("dst") == F.col("node")).select("src", F.col("m").alias("dst"))
    return told.where("hub IS NOT NULL").select("src", F.col("hub_m").alias("dst")).union(few).distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst")
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (src, dst) edges of whole numbers: component is its least node.

    Edges are first contracted where they stand. A round costs two joins on the node; the edges
    shrink to one a node, and the last EDGES of them are contracted in one task; hubs are met by pre-aggregated minima, and no task gathers the edges of one. Rounds go on until one changes
    nothing, told by the number and the sum of hashes of the edges; each frees what the one before
    wrote. Self loops name a node without linking it.
    """
    whole = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    first = stage(_contracted(whole), "edges")  # repeated ones of several tasks go in the first round
    star, kept = first.where("src != dst"), first.where("src = dst")
    seen = staged = None
    while True:
        state = star.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        if state[0] <= EDGES:
            star, last = stage(_contracted(star.coalesce(1)), "stars"), staged
            if last is not None:
                unstage(last)
            break
        large, least = _large_star(star, state[0])
        seen, star, before = state, stage(_small_star(large), "stars"), staged
        unstage(least)
        if before is not None:
            unstage(before)
        staged = star
    roots = star.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    lone = kept.select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = star.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots).union(lone)
    return found.groupBy("node").agg(F.min("component").alias("component"))
