"""Groups of unbounded size compared in bounded blocks.

A group of n members is cut into about n / rows blocks by hash; each pair of blocks is one unit of
work, so no task holds more than two blocks, and only per-member results leave it, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024
WEIGHT = 1_000_000


def with_blocks(members: DataFrame, group: str, node: str, weight: str | None = None, rows: int = ROWS, most_weight: int = WEIGHT) -> DataFrame:
    """members of groups of two or more, with `_block` and `_blocks`: counted over pre-aggregated group sizes."""
    blocks = F.ceil(F.count("*") / rows)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / most_weight))
    sizes = members.groupBy(group).agg(F.count("*").alias("_n"), blocks.cast("int").alias("_blocks")).where("_n > 1").drop("_n")
    return members.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))


def in_pairs(blocked: DataFrame, group: str, node: str) -> DataFrame:
    """Each member once for every pair of blocks that its own is in, sorted by pair within partitions."""
    other = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = other.select(
        F.col(group).alias("_group"), F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), *[c for c in blocked.columns if c not in (group, "_blocks")]
    )
    return paired.repartition("_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j", node)


def runs(batches: Iterable, keys: int, read: Callable) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows with equal keys; `read` makes arrays of a batch, the keys first."""
    carry: list[np.ndarray] | None = None
    for batch in batches:
        columns = read(batch)
        if not len(columns[0]):
            continue
        if carry is not None:
            columns = [np.concatenate(pair) for pair in zip(carry, columns, strict=True)]
        new = np.zeros(len(columns[0]), bool)
        for key in columns[:keys]:
            new[1:] |= key[1:] != key[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield [c[a:z] for c in columns]
        carry = [c[cuts[-1] :] for c in columns]
    if carry is not None:
        yield carry


def linked_roots(n: int, links: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Per member the first member that it is connected to; links(one, others) -> mask. A group that hangs together costs one look each."""
    root = np.full(n, -1)
    todo = np.arange(n)
    while len(todo):
        first, todo = int(todo[0]), todo[1:]
        root[first] = first
        queue = [first]
        while queue and len(todo):
            hit = links(queue.pop(), todo)
            if hit.any():
                root[todo[hit]] = first
                queue += todo[hit].tolist()
                todo = todo[~hit]
    return root


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """|A and B| for every row set and column set: products of 0/1 matrices over shared shingles."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[ids] > 1
    number = np.cumsum(seen > 1) - 1
    owner, ids = owner[shared], number[ids[shared]]
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    step = 4096
    cuts = np.searchsorted(ids, np.arange(0, (ids[-1] + 1 if len(ids) else 0) + step, step))
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == z:
            continue
        dense = np.zeros((len(sets), step), np.float32)
        dense[owner[a:z], ids[a:z] - k * step] = 1
        out += dense[rows] @ dense[columns].T
    return out.astype(np.int64)


def products(tokens: list[np.ndarray], weights: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Dot products of row vectors and column vectors, each given by its different tokens and their weights: over the tokens that two of them share."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, ids, seen = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = seen[ids] > 1
    owner, ids, x = owner[shared], (np.cumsum(seen > 1) - 1)[ids[shared]], np.concatenate(weights)[shared]
    out = np.zeros((len(rows), len(columns)))
    order = np.argsort(ids, kind="stable")
    owner, ids, x = owner[order], ids[order], x[order]
    step = 2048
    cuts = np.searchsorted(ids, np.arange(0, (ids[-1] + 1 if len(ids) else 0) + step, step))
    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        dense = np.zeros((len(tokens), step))
        dense[owner[a:z], ids[a:z] - k * step] = x[a:z]
        out += dense[rows] @ dense[columns].T
    return out
