"""As-of joins and neighbour counts where one key holds most rows, against brute force."""

import random
from collections import defaultdict

import pytest

from quillmesh.operators import aggregates, joins


@pytest.mark.parametrize("rows", [7, 1000])
def test_asof_with_a_hot_key_cut_into_ranges(spark, rows):
    rng = random.Random(rows)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    versions = [(key(), rng.choice([None, *range(10, 40)]), rng.randrange(100)) for _ in range(80)]
    asked = [(k, key() if k % 9 else 4, rng.choice([None, 12, 12, *range(50)])) for k in range(200)]
    right = spark.createDataFrame(versions, "s int, eff int, law int")
    left = spark.createDataFrame(asked, "_id long, s int, at int")
    expected = {}
    for i, s, t in asked:
        own = [(e, law) for k, e, law in versions if k == s and k is not None and e is not None]
        before = [x for x in own if t is not None and x[0] <= t]
        first = min(own, default=(None, None))[0]
        expected[i] = max(before) if before else max((x for x in own if x[0] == first), default=(None, None))
    got = joins.asof_join(left, right, "s", "at", "eff", "law", rows).collect()
    assert len(got) == len(asked) and {r._id: (r.eff, r.law) for r in got} == expected


def test_asof_of_empty_tables(spark):
    none = spark.createDataFrame([], "s int, eff int, law int")
    left = spark.createDataFrame([(1, 1, 5)], "_id long, s int, at int")
    assert [tuple(r) for r in joins.asof_join(left, none, "s", "at", "eff", "law").collect()] == [(1, None, None)]
    assert joins.asof_join(left.limit(0), none, "s", "at", "eff", "law").count() == 0


@pytest.mark.parametrize("large", [1, 3, 8, 1000])
def test_degrees_by_pairs_and_by_bitmaps(spark, large):
    rng = random.Random(large)
    members = [(c, rng.randrange(60)) for c in range(25) for _ in range(rng.choice([1, 2, 4, 15]))] + [(99, v) for v in range(40, 75)] + [(98, 500), (None, 1), (3, None)]
    chunks = defaultdict(set)
    for c, v in members:
        if c is not None and v is not None:
            chunks[c].add(v)
    near = defaultdict(set)
    for own in chunks.values():
        for v in own:
            near[v] |= own - {v}
    got = aggregates.degree_centrality(spark.createDataFrame(members, "c int, v int"), "c", "v", large).collect()
    assert {r.node: r.degree for r in got} == {v: len(w) for v, w in near.items() if w} and len(got) == len({r.node for r in got})


def test_a_chunk_of_a_hundred_thousand_members(spark):
    members = spark.range(100_000).selectExpr("0 AS c", "id AS v").unionByName(spark.range(10).selectExpr("1 AS c", "100000 - id AS v"))
    got = {(r.degree, r["count"]) for r in aggregates.degree_centrality(members, "c", "v").groupBy("degree").count().collect()}
    assert got == {(99_999, 99_991), (100_000, 9), (9, 1)}
