"""Vectors of many tokens met by sketches: the norms of their parts in classes of tokens, a few bytes a token.

The product of two vectors is at most that of their sketches, however classes are merged: no pair at the threshold is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.blocks import in_pairs, runs
from quillmesh.operators.components import least_linked

#: Classes that hold the tokens of a sketch.
CLASSES = 1 << 16
#: Sketches of a slice and cells of its matrix at most; pairs that are compared by all classes at once.
SLICE, CELLS, HITS = 1024, 1 << 20, 1 << 18
#: Blocks that sketches are met in at least, and tokens that a block holds at most.
LEAST_BLOCKS, BLOCK_TOKENS = 4, 32_000_000


def class_sketch(h: np.ndarray, high: np.ndarray) -> tuple[bytes, bytes, float]:
    """(classes of tokens, ascending, roots of their norms in bytes, scale): a class's norm is scale times the square of its byte, rounded up.

    Two vectors' product is at most that of their norms by class, however classes are merged.
    """
    at, own = np.unique((h >> 24) & (CLASSES - 1), return_inverse=True)
    norms = np.sqrt(np.bincount(own, high * high, len(at)))
    scale = norms.max(initial=0) / 255**2
    return at.astype(np.uint16).tobytes(), np.minimum(np.ceil(np.sqrt(norms / (scale or 1)) - 1e-9), 255).astype(np.uint8).tobytes(), float(scale)


def close_sketches(at: np.ndarray, root: np.ndarray, scale: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """For each sketch the first that pairs with a product over the threshold connect it to, one of a pair of side 1 or 3, the other of side 2 or 3.

    All pairs are met slice by slice, as products of matrices, with as many merged classes as the shorter has tokens; what passes and isn't
    connected yet is compared by all classes.
    """
    sizes = np.array([len(x) for x in root])
    slices = []  # (width, rows of one side)
    for own in (np.flatnonzero(side == k) for k in (1, 2, 3)):
        order, k = own[np.argsort(sizes[own], kind="stable")], 0
        while k < len(order):
            m = int(sizes[order[k]])
            width = min(CLASSES, 1 << max(7, (m * min(1024, max(256, m)) // 256 - 1).bit_length()))
            slices.append((width, order[k : k + max(64, min(SLICE, CELLS // width))]))
            k += len(slices[-1][1])
    slices.sort(key=lambda x: x[0])
    low = threshold - 1e-4
    label, whole = np.arange(len(sizes)), np.zeros(CLASSES)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def classes_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.frombuffer(b"".join(root[rows]), np.uint8).astype(np.float64)
        return np.frombuffer(b"".join(at[rows]), np.uint16), norms * norms * np.repeat(scale[rows], sizes[rows])

    def dense(rows: np.ndarray, width: int) -> np.ndarray:
        classes, norms = classes_of(rows)
        out = np.bincount(np.repeat(np.arange(len(rows)) * width, sizes[rows]) + (classes & (width - 1)), norms * norms, len(rows) * width)
        return np.sqrt(out, out=out).astype(np.float32).reshape(len(rows), width)

    def settle() -> None:
        nonlocal label
        short, long = (np.concatenate(c) for c in zip(*hits, strict=True))
        hits.clear()
        for k in range(0, len(short), HITS):
            one, other = short[k : k + HITS], long[k : k + HITS]
            apart = np.flatnonzero(label[one] != label[other])
            apart = apart[np.argsort(other[apart], kind="stable")]
            one, other = one[apart], other[apart]
            cuts = [0, *(np.flatnonzero(other[1:] != other[:-1]) + 1).tolist(), len(other)]
            linked = np.zeros(len(one), bool)
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a < z:
                    classes, norms = classes_of(other[a : a + 1])
                    whole[classes] = norms
                    its, weights = classes_of(one[a:z])
                    linked[a:z] = np.add.reduceat(whole[its] * weights, np.r_[0, np.cumsum(sizes[one[a:z]])[:-1]]) > low
                    whole[classes] = 0
            nodes, roots = least_linked(label[one[linked]], label[other[linked]])
            moved = np.arange(len(label))
            moved[nodes] = roots
            label = moved[label]

    for width in sorted({w for w, _ in slices}):
        own = [p for p, (w, _) in enumerate(slices) if w == width]
        step = max(1, 8 * CELLS // (SLICE * width))
        for k in range(0, len(own), step):
            held = [(p, slices[p][1], dense(slices[p][1], width)) for p in own[k : k + step]]
            for q in range(own[k], len(slices)):
                right = slices[q][1]
                met = [(p, left, x) for p, left, x in held if p <= q and side[left[0]] | side[right[0]] == 3]
                y = dense(right, width) if met else None
                for p, left, x in met:
                    a, b = np.divmod(np.flatnonzero((x @ y.T).ravel() > low), len(right))
                    one, other = left[a], right[b]
                    keep = (label[one] != label[other]) & ((p != q) | (a < b))
                    hits.append((one[keep], other[keep]))
                    if sum(len(x) for x, _ in hits) > HITS:
                        settle()
    if hits:
        settle()
    return label


def sketched_links(sketches: DataFrame, tokens: int, threshold: float) -> DataFrame:
    """(src, dst) that connect what pairs of (node, at, root, scale) sketches over the threshold do; all together they have about that many tokens.

    A sketch moves once a block, and blocks are as large as a task can hold.
    """
    blocks = max(LEAST_BLOCKS, -(-tokens // BLOCK_TOKENS))
    dealt = sketches.where(F.length("at") > 0).select("*", F.lit(0).alias("all"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("_block"), F.lit(blocks).alias("_blocks"))

    def read(batch):
        both = [np.empty(batch.num_rows, object) for _ in range(2)]
        for o, k in zip(both, ("at", "root"), strict=True):
            o[:] = batch.column(k).to_pylist()
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "node", "_block", "scale")), *both]

    def connect(batches):
        for _, i, j, node, block, scale, at, root in runs(batches, 3, read):
            first = close_sketches(at, root, scale, (block == i[0]) * 1 + (block == j[0]) * 2, threshold)
            moved = first != np.arange(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(node[first[moved]]), pa.array(node[moved])], names=["src", "dst"])

    return in_pairs(dealt, "all", "node").mapInArrow(connect, "src long, dst long")
