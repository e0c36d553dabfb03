"""Centroid clustering by Elkan's bounds, exact to the last tie.

A vector's components become whole numbers, floor(scale * x). Each pass over the rows reads the bounds
that the pass before wrote beside the vector: one above its distance to its own centroid and one below
its distance to every centroid. Bounds move by how far centroids moved; a centroid is left out where
its lower bound, or half its distance from the vector's own, is strictly above the upper bound, so one
at equal distance is always compared. Bounds are rounded outwards, compared distances are whole numbers.

A pass is narrow: no row is exchanged. Each task writes its rows and one row of sums; the driver gets
sums by (centroid, component), the size of the centroids however long the table.

Defined cases: vectors that are null, of another length or hold null or non-finite components are left
out; repeated rows are vectors of their own; starts tie by the vector's components, and null ids start last;
with fewer vectors than centroids there are as many centroids as vectors; no vector gives an empty
result; a distance or inertia beyond a long is null; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.runtime import stage, table, unstage

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Sums of squares up to this are whole in double precision.
WHOLE = 1 << 53
LIMB = 40
COUNT, DISTANCE, CALCULATED = -1, -2, -3


def up(x):
    return np.nextafter(x, np.inf)


def down(x):
    return np.maximum(np.nextafter(x, -np.inf), 0)


def narrowed(x: np.ndarray, towards: float) -> np.ndarray:
    """Single precision, rounded towards +-inf."""
    return np.nextafter(x.astype(np.float32), np.float32(towards))


def root_above(square: int) -> float:
    return float(up(math.sqrt(square))) if square < 1 << 1000 else math.inf


def root_below(square: int) -> float:
    return float(down(math.sqrt(min(square, 1 << 1000))))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole doubles, or as Python's integers where doubles can't hold their squares."""
    with np.errstate(over="ignore"):
        q = np.floor(x * scale)
    if not q.size or fits(np.abs(q).max(), x.shape[1]):
        return q
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        value = float(value)
        out[at] = int(value) * scale if abs(value) >= WHOLE else math.floor(value * scale)
    return out


def fits(most: float, dim: int) -> bool:
    """Whether squared distances of vectors with components up to `most` are whole in double precision."""
    return bool(4 * dim * most * most < WHOLE)


def squares(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = rows - centroid
    return np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)


class Pass:
    """One assignment of all vectors, given the centroids, those before and how far each moved."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.k = len(centroids)
        self.exact = np.array(centroids, object)
        self.fast = fits(max(abs(v) for c in centroids for v in c), len(centroids[0]))
        self.centroids = self.exact.astype(np.float64) if self.fast else self.exact
        square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        self.moved = np.array([root_above(square(a, b)) if a != b else 0.0 for a, b in zip(centroids, before or centroids, strict=True)])
        self.half = down(np.array([[root_below(square(a, b)) for b in centroids] for a in centroids]) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(axis=1)
        self.calculated = 0

    def plain(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distances to all centroids."""
        self.calculated += len(q) * self.k
        if not self.fast and q.dtype != object:
            q = q.astype(np.int64).astype(object)
        centroids = self.centroids if q.dtype != object else self.exact
        d = np.stack([squares(q, c) for c in centroids], axis=1)
        return (d.argmin(axis=1) if d.dtype != object else np.array([min(range(self.k), key=r.__getitem__) for r in d], np.int64)), d

    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper, lower and squared distance from every centroid."""
        cluster, d = self.plain(q)
        own = d[np.arange(len(q)), cluster]
        if d.dtype == object:  # too long for doubles: bounds that rule nothing out
            return cluster, np.full(len(q), np.inf), np.zeros(d.shape), own
        return cluster, up(np.sqrt(own)), down(np.sqrt(d)), own

    def bounded(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same as all(), by the bounds of the pass before."""
        if q.dtype == object or not self.fast:
            return self.all(q)
        cluster = cluster.copy()
        upper, lower = up(upper + self.moved[cluster]), down(lower - self.moved)
        own = np.full(len(q), -1.0)  # not calculated
        open_ = np.flatnonzero(upper >= self.near[cluster])
        for j in range(self.k):
            at = open_[cluster[open_] != j]
            for tightened in (False, True):  # the upper bound becomes the distance only if it doesn't suffice
                at = at[(lower[at, j] <= upper[at]) & (self.half[cluster[at], j] <= upper[at])]
                loose = at[own[at] < 0]
                if tightened or not len(loose):
                    break
                self.measure(q, loose, cluster, own, upper, lower)
            if not len(at):
                continue
            d = squares(q[at], self.centroids[j])
            self.calculated += len(at)
            lower[at, j] = down(np.sqrt(d))
            better = (d < own[at]) | ((d == own[at]) & (j < cluster[at]))
            won = at[better]
            cluster[won], own[won] = j, d[better]
            upper[won] = up(np.sqrt(own[won]))
        return cluster, upper, lower, own

    def measure(self, q, at, cluster, own, upper, lower) -> None:
        """The distance of rows `at` from their own centroid."""
        own[at] = squares(q[at], self.centroids[cluster[at]])
        self.calculated += len(at)
        upper[at] = up(np.sqrt(own[at]))
        lower[at, cluster[at]] = down(np.sqrt(own[at]))

    def distances(self, q: np.ndarray, cluster: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances from the own centroid, calculated where that is open."""
        if own.dtype == object:
            return own
        at = np.flatnonzero(own < 0)
        if len(at):
            own = own.copy()
            own[at] = squares(q[at], self.centroids[cluster[at]])
        return own


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as (place, part): the sum of part << (LIMB * place)."""
    place = 0
    while value not in (0, -1):
        if part := value & ((1 << LIMB) - 1):
            yield place, part
        value >>= LIMB
        place += 1
    if value:
        yield place, value


def sums_of(frame: DataFrame) -> dict[tuple[int, int], int]:
    """{(cluster, component): sum} over the sums that tasks wrote; at COUNT, DISTANCE and CALCULATED those."""
    parts = (
        frame.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.*")
        .groupBy("cluster", "component", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    )
    out: dict = {}
    for r in parts.collect():  # clusters * (components + 3) * places
        key = (r["cluster"], r["component"])
        out[key] = out.get(key, 0) + (int(r["value"]) << (LIMB * r["place"]))
    return out


def assigned(rows: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, scale: int, last: bool) -> DataFrame:
    """rows with cluster, bounds and (last) distance, and a row of sums for each task."""
    id_type, vector_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "v"))
    dim = len(centroids[0])
    sums_type = pa.list_(pa.struct([("cluster", pa.int32()), ("component", pa.int32()), ("place", pa.int32()), ("value", pa.int64())]))

    def run(batches):
        step = Pass(centroids, before)
        totals: dict[tuple[int, int], int] = {}
        kinds: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [batch.column(0).type, batch.column(1).type]
            q = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), scale)
            if before is None:
                cluster, upper, lower, own = step.all(q)
            else:
                bounds = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, step.k)
                cluster, upper, lower, own = step.bounded(q, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.float64), bounds)
            for j in np.unique(cluster).tolist():
                at = cluster == j
                values = {COUNT: int(at.sum())}
                values |= {c: int(v) for c, v in enumerate(q[at].sum(axis=0))}
                for c, v in values.items():
                    totals[j, c] = totals.get((j, c), 0) + v
            out = [None] * batch.num_rows
            if last:
                out = [int(d) for d in step.distances(q, cluster, own)]
                for j, d in zip(cluster.tolist(), out, strict=True):
                    totals[j, DISTANCE] = totals.get((j, DISTANCE), 0) + d
                out = [d if d < 1 << 63 else None for d in out]
            low = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, step.k), pa.int32()), pa.array(narrowed(lower, -np.inf).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(narrowed(upper, np.inf)), low, pa.array(out, pa.int64()), pa.nulls(len(out), sums_type)], names=NAMES
            )
        if totals:
            totals[0, CALCULATED] = step.calculated
            sums = [(j, c, place, part) for (j, c), v in totals.items() for place, part in limbs(v)]
            own_row = [pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *(pa.nulls(1, t) for t in (pa.int32(), pa.float32(), pa.list_(pa.float32()), pa.int64()))]
            struct = [dict(zip(("cluster", "component", "place", "value"), s, strict=True)) for s in sums]
            yield pa.RecordBatch.from_arrays([*own_row, pa.array([struct], sums_type)], names=NAMES)

    schema = f"vec_id {id_type}, v {vector_type}, cluster int, upper float, lower array<float>, distance long, sums array<struct<cluster: int, component: int, place: int, value: long>>"
    return rows.mapInArrow(run, schema)


NAMES = ["vec_id", "v", "cluster", "upper", "lower", "distance", "sums"]


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v) of the vectors of `dim` finite components."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where((F.size("embedding") == dim) & finite).select("vec_id", v.alias("v"))


def starts(rows: DataFrame, clusters: int, scale: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash least: `clusters` rows at most."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return [[int(x) for x in whole(np.array([r["v"]], np.float64), scale)[0]] for r in first]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED):
    """(rows, centroids, sums by pass): vec_id, v, cluster, distance of each vector after `rounds` rounds and a last assignment."""
    rows = usable(vectors, dim)
    centroids, before, done, passes = starts(rows, clusters, scale, seed), None, None, []
    if not centroids:
        return rows.withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("long")), [], []
    for number in range(rounds + 1):
        state = rows if done is None else done.where("sums IS NULL").select(*NAMES[:5])
        new = stage(assigned(state, centroids, before, scale, number == rounds), "centroids")
        if done is not None:
            unstage(done)
        done = new
        passes.append(sums_of(done))
        if number < rounds:
            before = centroids
            centroids = [
                [passes[-1].get((j, c), 0) // n for c in range(dim)] if (n := passes[-1].get((j, COUNT), 0)) else old for j, old in enumerate(before)
            ]  # fmt: skip  floor, also of negative sums
    return done.where("sums IS NULL").select("vec_id", "v", "cluster", "distance"), centroids, passes


def centroid_clusters(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector of (vec_id, embedding)."""
    rows, centroids, passes = clustered(vectors, **options)
    long_or_none = lambda v: v if v < 1 << 63 else None
    inertia = [passes[-1].get((j, DISTANCE), 0) for j in range(len(centroids))]
    named = [
        (j, long_or_none(inertia[j]), long_or_none(sum(inertia)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(centroids)
    ]
    heads = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("v").join(F.broadcast(heads), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB, every distance calculated."""
    parts = [
        """kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        """c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1)::INTEGER AS c, q FROM kept
  QUALIFY c < 16)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, c, list_sum(list_transform(list_zip(kept.q, c{r}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{r}) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM kept JOIN a{r} USING (rid)) GROUP BY c, i)""")
            parts.append(f"""c{r + 1} AS (
  SELECT c{r}.c, coalesce(new, q) AS q FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS new FROM m{r} GROUP BY c) m ON m.c = c{r}.c)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c)
"""


OP11_SQL = _sql()
