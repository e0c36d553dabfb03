import random

from quillmesh.operators import graph
from quillmesh.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    cases = [[(1, 100), (2, 100), (2, 101)], [(k, k + 1) for k in range(40)], [(5, 5)], [(0, k) for k in range(1, 30)]]
    cases += [[(rng.randrange(60), rng.randrange(60)) for _ in range(rng.choice([10, 30, 60]))] for _ in range(6)]
    cases.append([(rng.randrange(100), 1000 + rng.randrange(100)) for _ in range(120)])
    for edges in cases:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_every_edge(spark, tmp_path):
    spark.createDataFrame([(1, 1, 50.0), (2, 1, 3.0), (2, 2, 4.0), (3, 2, 50.0), (4, 3, 1.0)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = graph.gr3(spark, str(tmp_path)).first()
    assert (got.n_components, got.n_nodes) == (2, 7)
