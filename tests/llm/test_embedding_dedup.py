import numpy as np

from quillmesh.llm import embedding_dedup


def brute(rows, cosine=0.93):
    rows = [(i, None if e is None else np.array([np.nan if x is None else x for x in e], np.float64), l) for i, e, l in rows]
    ok = [e is not None and l is not None and len(e) > 0 and np.isfinite(e).all() and (e != 0).any() for _, e, l in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if ok[a] and ok[b] and x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] >= cosine * np.linalg.norm(x[1]) * np.linalg.norm(y[1]):
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    heads = {}
    for k, r in enumerate(rows):
        heads[find(k)] = min(heads.get(find(k), r[0]), r[0])
    return sorted((r[0], n[k], heads[find(k)]) for k, r in enumerate(rows))


def made():
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(64).tolist(), int(rng.integers(0, 3))) for k in range(150)]
    for g in range(12):
        base, label = rng.standard_normal(64), int(rng.integers(0, 3))
        rows += [(1000 + 100 * g + k, (base + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.28])).tolist(), label) for k in range(int(rng.integers(2, 30)))]
    rows += [(5000 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 2)]
    rows += [(6000, rows[0][1], 1 - min(1, rows[0][2])), (6001, rows[0][1], None), (6002, None, 1), (6003, [0.0] * 64, 1), (6004, [], 1)]
    rows += [(6005, [float("nan")] + [1.0] * 63, 1), (6006, [None] + [1.0] * 63, 1), (6007, [float("inf")] + [1.0] * 63, 1), (6008, [1.0] * 64, 1), (6009, [2.0] * 64, 1), (6010, [1.0] * 32, 1)]
    return rows


def test_equals_brute_force(spark):
    rows = made()
    for kind in ("double", "float"):
        if kind == "float":
            rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], l) for i, e, l in rows]
        frame = spark.createDataFrame([(*r, True) for r in rows], f"vec_id long, embedding array<{kind}>, label int, kept boolean")
        got = embedding_dedup.embedding_dedup(frame).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_tiny_and_huge_vectors(spark):
    vectors = [[1e-200, 0.5e-200], [1.0, 2.0], [2.0, 1.0], [1e200, 2e200], [5e-324, 0.0], [3.0, 0.01], [1.7e308, -1.7e308], [1.0, -1.0], [-0.0, 1.0], [0.0, 4.0]]
    frame = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(frame).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8)]


def test_a_bucket_shared_by_chance_is_told_apart():
    labels, raw = np.array([1, 2, 1, 1, 2], object), np.array([b"12345678", b"12345678", b"1234567812345678", b"87654321", b"abcdefgh"], object)
    assert [g.tolist() for g in embedding_dedup.alike(labels, raw)] == [[0, 3], [1, 4], [2]]


def test_blocks(spark, monkeypatch):
    import quillmesh.llm.blocks as blocks

    monkeypatch.setattr(blocks.with_blocks, "__defaults__", (None, 8, 10**6))
    rows = made()
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in embedding_dedup.embedding_dedup(frame).collect())
    assert got == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x, z = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = embedding_dedup.COSINE
    a, b = (embedding_dedup.polytope_keys(v) for v in (x, c * x + np.sqrt(1 - c * c) * z))
    assert np.mean([len(np.intersect1d(u, v)) > 0 for u, v in zip(a, b, strict=True)]) > 0.999


def test_query_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = embedding_dedup.op3_embedding_dedup(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
