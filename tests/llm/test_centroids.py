import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quillmesh.llm import centroids


def brute(rows, clusters=16, rounds=3, dim=64):
    """The rule by whole numbers and every distance."""
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    means = [q for _, q in order[:clusters]]

    def assign():
        out = []
        for _, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in means]
            j = min(range(len(means)), key=lambda k: (d[k], k))
            out.append((j, d[j]))
        return out

    for _ in range(rounds):
        at = [j for j, _ in assign()]
        for j in range(len(means)):
            own = [q for (_, q), k in zip(kept, at, strict=True) if k == j]
            if own:
                means[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    inertia = [sum(d for k, d in last if k == j) for j in range(len(means))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    fit = lambda v: v if v < 1 << 63 else None
    return sorted((((i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), sha[j]) for (i, _), (j, d) in zip(kept, last, strict=True))), key=repr)


def run(spark, rows, kind="float", **options):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], f"vec_id long, embedding array<{kind}>, sums string, cluster int").repartition(3)
    return sorted(map(tuple, centroids.centroid_clusters(frame, **options).collect()), key=repr)


def made(n=400):
    rng = np.random.default_rng(11)
    middles = rng.standard_normal((12, 64))
    rows = [(k, (middles[k % 12] + rng.standard_normal(64) * 0.3).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + k, np.round(rng.standard_normal(64)).tolist()) for k in range(60)]  # small whole numbers tie
    rows += [(k, rows[k][1]) for k in range(0, 50, 3)]
    rows += [(None, rows[3][1]), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [float("nan")] + [0.0] * 63), (2004, [None] + [0.0] * 63), (2005, [float("-inf")] + [0.0] * 63)]
    return rows


def test_equals_brute_force(spark):
    rows = made()
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.integers(-1, 2, 64) * (rng.random(64) < 0.05)).astype(float).tolist()) for k in range(300)]
    assert run(spark, rows, "double") == brute(rows)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e30, 1.7e308])
def test_long_components_stay_whole(spark, size):
    rows = [(k, [x * size for x in v]) if k % 7 == 0 else (k, v) for k, v in made(60)[:60]]
    rows = [(k, [max(-1.79e308, min(1.79e308, x)) for x in v]) for k, v in rows]
    assert run(spark, rows, "double") == brute(rows)


def test_short_rows_against_long_centroids():
    far = [[1 << 40] * 64, [0] * 64, [(1 << 40) + 1] * 64]
    q = np.ones((3, 64))
    cluster, _, _, own = centroids.Pass(far, None).all(q)
    assert cluster.tolist() == [1, 1, 1] and own.tolist() == [64] * 3
    assert centroids.Pass(far, None).plain(q)[1][0][0] == 64 * ((1 << 40) - 1) ** 2


def test_few_rows_and_none(spark):
    rows = made()[:5] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(None, [0.0] * 64), (None, [1.0] * 64)]) == brute([(None, [0.0] * 64), (None, [1.0] * 64)])


def test_bounds_leave_out_distances(spark):
    rng = np.random.default_rng(5)
    middles = 3 * rng.standard_normal((16, 64))
    rows = [(k, (middles[k % 16] + rng.standard_normal(64)).tolist()) for k in range(1600)]
    _, _, passes = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    calculated = [p[0, centroids.CALCULATED] for p in passes]
    assert calculated[0] == 1600 * 16 and calculated[-1] < 1600 * 8


def test_bounds_hold():
    """Whatever the centroids did, the bounds are on their sides and clusters are those of all distances."""
    rng = np.random.default_rng(8)
    q = rng.integers(-40, 40, (500, 64)).astype(float)
    before = [[int(x) for x in c] for c in rng.integers(-40, 40, (16, 64))]
    cluster, upper, lower, _ = centroids.Pass(before, None).all(q)
    for spread in (0, 1, 5, 30):
        now = [[x + int(d) for x, d in zip(c, rng.integers(-spread, spread + 1, 64), strict=True)] for c in before]
        step, plain = centroids.Pass(now, before), centroids.Pass(now, None)
        narrow = (centroids.narrowed(upper, np.inf).astype(float), centroids.narrowed(lower, -np.inf).astype(float))
        cluster, upper, lower, own = step.bounded(q, cluster, *narrow)
        expected, d = plain.plain(q)
        assert (cluster == expected).all() and (upper**2 >= d[np.arange(500), cluster]).all() and (lower**2 <= d).all()
        assert (step.distances(q, cluster, own) == d[np.arange(500), cluster]).all()
        before = now


def test_limbs():
    for value in (0, 1, -1, 1 << 40, -(1 << 40), 12345678901234567890123, -12345678901234567890123):
        assert sum(part << (centroids.LIMB * place) for place, part in centroids.limbs(value)) == value


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, centroids.op11_centroid_clusters(spark, sf_dir).collect()), key=repr)
    assert got == sorted(con.sql(centroids.OP11_SQL).fetchall(), key=repr)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got == brute(rows)
