"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A hash is the largest coordinate, with its sign, after three rounds of random signs and a Hadamard
transform; `HASHES` of them make a table's key and `TABLES` tables are kept. Besides its own key a
vector enters the keys at which the hashes that were least sure take their second choice (multiprobe).

Vectors of one label that are equal, component by component, are one class. Classes that share a
key are compared (in blocks) by cosine in double precision, which connects them; then all pairs of
each connected cluster are compared (in blocks), so a link counts even where only other links led
there. No pair is emitted: a class leaves with its number of links and a root.

Vectors are divided by their largest magnitude first, so that no norm over- or underflows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
without a label, link with nothing and are kept; vectors of different lengths never link; repeated
rows and equal vectors link with each other; a null vec_id takes part and names no component unless
alone; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.blocks import in_pairs, linked_roots, runs, with_blocks
from quillmesh.operators.components import components
from quillmesh.runtime import stage, table

COSINE = 0.93
TABLES = 16
HASHES = 3
PROBES = 3
SEED = 93


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotations(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).choice(np.array([-1.0, 1.0]), size=(number, 3, dim))


def polytope_keys(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(n, tables * (1 + probes)) keys: of each table its own and the probes'."""
    n, dim = vectors.shape
    size = max(2, 1 << (dim - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :dim] = vectors
    signs = rotations(size, tables * hashes)
    row, out = np.arange(n), []
    for t in range(tables):
        first, second, gap = [], [], []
        for signed in signs[t * hashes : (t + 1) * hashes]:
            y = x
            for s in signed:
                y = hadamard(y * s)
            a = np.abs(y)
            i = a.argmax(axis=1)
            top = a[row, i].copy()
            a[row, i] = -1
            j = a.argmax(axis=1)
            first.append(2 * i + (y[row, i] < 0))
            second.append(2 * j + (y[row, j] < 0))
            gap.append((top - a[row, j]) / np.maximum(top, 1e-300))
        first, second = np.array(first, np.int64), np.array(second, np.int64)
        choices = [(np.zeros(n), np.zeros((hashes, n), bool))]  # cost and changed hashes of every combination
        for k in range(hashes):
            choices += [(cost + gap[k], changed | (np.arange(hashes)[:, None] == k)) for cost, changed in list(choices)]
        costs = np.array([c for c, _ in choices])
        order = np.argsort(costs, axis=0, kind="stable")[: 1 + probes]
        changes = np.array([c for _, c in choices])
        for pick in order:
            changed = changes[pick, :, row].T
            code = np.full(n, t, np.int64)
            for value in np.where(changed, second, first):
                code = code * (2 * size) + value
            out.append(code)
    return np.array(out).T


def matrix(column: list, kind: str) -> np.ndarray:
    """Vectors of one length as rows, each divided by its largest magnitude: no square of one over- or underflows."""
    v = np.frombuffer(b"".join(column), kind).astype(np.float64).reshape(len(column), -1)
    return v / np.abs(v).max(axis=1, keepdims=True)


def alike(labels: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
    """The rows of each label and length."""
    groups: dict = {}
    for k, key in enumerate(zip(labels.tolist(), map(len, raw), strict=True)):
        groups.setdefault(key, []).append(k)
    return [np.array(g) for g in groups.values()]


def objects(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def vector_classes(rows: DataFrame, kind: str) -> DataFrame:
    """c, label, dim, vector (bytes), first, copies: a row for each vector of each label."""

    def pack(batches):
        for batch in batches:
            values = [np.array(v, kind).tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([len(v) for v in values], pa.int32()), pa.array(values, pa.binary())], names=["vec_id", "label", "dim", "vector"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, dim int, vector binary"
    packed = rows.mapInArrow(pack, schema)
    return packed.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("c", F.monotonically_increasing_id())


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def connected(found: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(node, component) of classes that links found in shared keys connect."""

    def keyed(batches):
        for batch in batches:
            nodes, vectors = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                keys = polytope_keys(matrix([vectors[k] for k in at], kind))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(list(keys), pa.list_(pa.int64()))], names=["c", "keys"])

    keys = found.select("c", "dim", "vector").mapInArrow(keyed, "c long, keys array<long>").withColumn("key", F.explode(F.array_distinct("keys"))).drop("keys")
    named = keys.join(found.select("c", "label", "dim"), "c").select("c", F.xxhash64("label", "dim", "key").alias("key"))
    entries = with_blocks(named, "key", "c").join(found.select("c", "label", "vector"), "c")

    def read(batch):
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "c")), objects(batch.column("label")), objects(batch.column("vector"))]

    def connect(batches):
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for *_, c, label, raw in runs(batches, 3, read):
            for own in alike(label, raw):  # a bucket's name is a hash: others may share it by chance
                v, ids = matrix(list(raw[own]), kind), c[own]
                norm = _norms(v)
                roots = linked_roots(len(ids), lambda one, others, v=v, norm=norm: v[others] @ v[one] >= cosine * norm[others] * norm[one])
                linked = roots != np.arange(len(ids))
                src.append(ids[linked])
                dst.append(ids[roots[linked]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    return components(in_pairs(entries, "key", "c").mapInArrow(connect, "src long, dst long"))


def counted(found: DataFrame, clusters: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(c, root, linked) per block pair of a cluster: the vectors that a class links with, copies counted."""
    members = with_blocks(clusters.join(found.select(F.col("c").alias("node"), "label", "vector", "copies"), "node"), "component", "node")

    def read(batch):
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "node", "_block", "copies")), objects(batch.column("vector"))]

    def count(batches):
        for _, i, j, c, block, copies, raw in runs(batches, 3, read):
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            if not len(left) or not len(right):
                continue
            v = matrix(list(raw), kind)  # links connect vectors of one label and length only
            norm = _norms(v)
            link = v[left] @ v[right].T >= cosine * norm[left][:, None] * norm[right][None, :]
            link &= left[:, None] != right[None, :]
            linked = np.zeros(len(c), np.int64)
            linked[left] += link @ copies[right]
            if i[0] != j[0]:
                linked[right] += link.T @ copies[left]
            whole = np.zeros((len(c), len(c)), bool)
            whole[np.ix_(left, right)] = link
            whole |= whole.T
            roots = linked_roots(len(c), lambda one, others, w=whole: w[one, others])
            out = linked > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (c, c[roots], linked)], names=["c", "root", "linked"])

    return in_pairs(members.select("node", "component", "_block", "_blocks", "copies", "vector"), "component", "node").mapInArrow(count, "c long, root long, linked long")


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stage(vectors.select("vec_id", "embedding", "label", usable.alias("usable")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    found = stage(vector_classes(rows.where("usable"), kind), "vector-classes")
    links = stage(counted(found, connected(found, kind, cosine), kind, cosine), "vector-links")
    totals = links.groupBy("c").agg(F.sum("linked").alias("linked"))
    clusters = components(links.select(F.col("c").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "c")
    named = clusters.join(found.select("c", "first"), "c")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    known = found.join(totals.join(named.select("c", "component").join(heads, "component"), "c"), "c", "left").select(
        "label", "vector", "copies", F.coalesce("head", "first").alias("head"), F.coalesce("linked", F.lit(0)).alias("linked")
    )

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.array(v, kind).tobytes() for v in batch.column(2).to_pylist()], pa.binary())], names=["vec_id", "label", "vector"])

    label = f"label {vectors.schema['label'].dataType.simpleString()}"
    ids = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}"
    own = rows.where("usable").select("vec_id", "label", "embedding").mapInArrow(pack, f"{ids}, {label}, vector binary")
    judged = own.join(known, ["label", "vector"]).select("vec_id", (F.col("copies") - 1 + F.col("linked")).alias("n_links"), F.col("head").alias("component_id"))
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


#: The same in DuckDB: all pairs of a label, links closed by recursion.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM s),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.93 * a.norm * b.norm),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
heads AS (SELECT a, least(a, min(b)) AS head FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(head, vec_id) AS component_id, coalesce(head, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN heads ON heads.a = vec_id
"""
