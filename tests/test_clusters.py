import math

import numpy as np
import pytest

from quillmesh.operators import clusters, views


def km(a, b):
    (la, lo), (lb, lp) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def brute(rows, radius=10.0):
    """The sequential pass. rows: (id, lat, lon, by)."""
    out, free = {}, sorted(set(rows), key=lambda r: r[:3])
    while free:
        seed = free[0]
        taken = [r for r in free if r[3] == seed[3] and km(r[1:3], seed[1:3]) < radius]
        out |= {r: seed[0] for r in taken}
        free = [r for r in free if r not in set(taken)]
    return sorted((r[3] if r[3] is not None else -1, r[0], out[r]) for r in rows)


def run(spark, rows, finish, by="by"):
    frame = spark.createDataFrame([(r[0], float(r[1]), float(r[2]), r[3], 1.0, "x") for r in rows], "id long, lat double, lon double, by int, cy double, seed string")
    return sorted((r.by if r.by is not None else -1, r.id, r.seed) for r in clusters.greedy_seed_clusters(frame, by, 10.0, finish).collect())


def spread(kind, n=130):
    rng = np.random.default_rng(7)
    if kind == "dense":
        return [(int(i), 30 + x * 0.3, 70 + y * 0.3, 0) for i, (x, y) in zip(rng.permutation(n), rng.random((n, 2)), strict=True)]
    if kind == "line":  # each depends on the one before
        return [(k, 10.0, 20 + k * 0.06, None) for k in range(24)]
    if kind == "poles":
        return [(int(i), s * (89.8 + 0.2 * a), 360 * b - 180, 1) for i, (a, b), s in zip(rng.permutation(n), rng.random((n, 2)), rng.choice([-1, 1], n), strict=True)]
    if kind == "dateline":
        return [(int(i), 60 + x, 179.9 + y * 0.2 - 360 * (y > 0.5), 2) for i, (x, y) in zip(rng.permutation(n), rng.random((n, 2)), strict=True)]
    return [(int(rng.integers(0, 80)), float(rng.integers(0, 6)) / 20, float(rng.integers(0, 6)) / 20, int(rng.integers(0, 3))) for _ in range(n)]  # places and ids repeat


@pytest.mark.parametrize("kind", ["dense", "line", "poles", "dateline", "repeats"])
def test_rounds_equal_the_sequential_pass(spark, kind):
    rows = spread(kind)
    assert run(spark, rows, 0) == brute(rows)


def test_one_task_ends_the_same(spark):
    rows = spread("dense") + [(500 + k, a, b, 5) for k, (_, a, b, _) in enumerate(spread("repeats", 40))]
    assert run(spark, rows, 10**6) == run(spark, rows, 30) == brute(rows)


def test_cells_hold_what_is_near():
    """No two points of a cell are as far as the radius apart."""
    height = clusters._bands(10.0)
    for band in (0, 1, -1, 700, int(89 / height), int(90 / height)):
        low = min(abs(band * height), abs((band + 1) * height)) if band not in (0, -1) else 0
        width = 360 / max(1, math.ceil(360 * math.cos(math.radians(min(low, 90))) / height))
        for lat in (band * height, (band + 1) * height):
            other = (band + 1) * height if lat == band * height else band * height
            if abs(lat) <= 90 and abs(other) <= 90:
                assert km((lat, 0), (other, width)) < 10


def test_broken_and_no_rows(spark):
    schema = "id long, lat double, lon double"
    rows = [(1, 10.0, 10.0), (None, 1.0, 1.0), (2, None, 1.0), (3, 1.0, None), (4, float("nan"), 1.0), (5, 91.0, 0.0), (1, 10.0, 10.0)]
    assert [tuple(r) for r in clusters.greedy_seed_clusters(spark.createDataFrame(rows, schema), None, 10.0).collect()] == [(1, 1), (1, 1)]
    assert clusters.greedy_seed_clusters(spark.createDataFrame([], schema), None, 10.0).count() == 0


def test_confidence_of_the_events(spark, sf_dir):
    events = views.geo_events(spark, sf_dir).collect()
    seed = {i: s for _, i, s in brute([(r.id, r.lat, r.lon, None) for r in events])}
    groups = {}
    for r in events:
        groups.setdefault(seed[r.id], []).append(r)
    got = {r.seed: r for r in clusters.gr10d(spark, sf_dir).collect()}
    assert set(got) == set(groups)
    for k, rows in groups.items():
        most, sources, mean = max(r.confidence for r in rows) / 250, {r.source for r in rows}, sum(round(r.lat * 1e6) for r in rows) // len(rows)
        fused = most if len(rows) == 1 else min(0.98, most + 0.12 * len(sources) + mean // 1000 % 9 / 100)
        assert (got[k].size, got[k].sources, got[k].types) == (len(rows), len(sources), len({r.type for r in rows}))
        assert abs(got[k].confidence - fused) <= 0.0051 and got[k].lat_millionths == mean
    by_source = brute([(r.id, r.lat, r.lon, r.source) for r in events])
    assert sorted((r.id, r.seed) for r in clusters.gr10c(spark, sf_dir).collect()) == sorted((i, s) for _, i, s in by_source)
