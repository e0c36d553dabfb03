import numpy as np
import pytest

from quillmesh.operators import vector_index
from quillmesh.runtime import shared_dir


def nearest(rows, queries, k=10):
    """Exact neighbours of each query."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        score = np.round(x @ x[ids == q][0], 6)
        out[q] = [int(i) for i in ids[np.lexsort((ids, -score))] if i != q][:k]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def recall(got, exact):
    return np.mean([len(set(got.get(q, [])) & set(e)) / len(e) for q, e in exact.items()])


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_recall_over_all_rows(spark, sf_dir, folder):
    sf = sf_dir.rsplit("/", 1)[0] + "/" + folder
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    exact = nearest(rows, [i for i, _ in rows if i % 100 == 0])
    got = found(vector_index.t3b(spark, sf))
    assert set(got) == set(exact) and recall(got, exact) >= 0.9


def test_train_add_search_apart(spark, tmp_path, monkeypatch):
    """Rows added after training are found; blocks and a crowded cell change nothing."""
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((20, 32))
    rows = [(k, (middles[k % 20] + 0.4 * rng.standard_normal(32)).tolist(), "x") for k in range(1500)]
    rows += [(5000 + k, (middles[0] + 1e-3 * rng.standard_normal(32)).tolist(), "x") for k in range(700)]  # a third in one cell
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    folder = f"file://{tmp_path}/index"
    vector_index.train_index(frame.where("vec_id < 1000"), folder, cells=8, words=64)
    vector_index.add_vectors(spark, folder, frame.where("vec_id < 1000"))
    queries = frame.where("vec_id % 100 = 0")
    vector_index.add_vectors(spark, folder, frame.where("vec_id >= 1000"))
    exact = nearest([r[:2] for r in rows], [r[0] for r in rows if r[0] % 100 == 0])
    plain = found(vector_index.search_index(spark, folder, queries, probes=6))
    assert recall(plain, exact) >= 0.9 and any(v >= 1000 for v in plain[0])
    near = [q for q in exact if q >= 5000]
    assert near and all(plain[q] == exact[q] for q in near)  # copies that codes can't tell apart
    monkeypatch.setattr(vector_index, "CODE_BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    assert recall(found(vector_index.search_index(spark, folder, queries, probes=6)), exact) >= 0.9


def test_broken_vectors_and_repeats(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(80)]
    broken = [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [1.0] * 8), (206, [float("inf")] + [0.0] * 15), (300, [1e300] * 16), (301, [1e-300] * 16)]
    kind = "vec_id long, embedding array<double>"
    folder = f"file://{tmp_path}/index"
    frame = spark.createDataFrame(rows + rows[:5] + broken, kind)
    vector_index.train_index(spark.createDataFrame(rows, kind), folder, cells=4, words=16)
    vector_index.add_vectors(spark, folder, frame)
    got = found(vector_index.search_index(spark, folder, frame, k=5, probes=4))
    assert set(got) == {*range(80), 300, 301} and got[300][0] == 301 and all(len(set(v)) == 5 for v in got.values())
    assert recall(got, nearest(rows + [(300, [1.0] * 16), (301, [1.0] * 16)], range(80), 5)) >= 0.99
    assert vector_index.search_index(spark, folder, frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no usable"):
        vector_index.train_index(frame.limit(0), f"{shared_dir(spark)}/none")
