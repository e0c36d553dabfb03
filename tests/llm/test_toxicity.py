import random
import zlib

from quillmesh.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    docs, labels = [], []
    for k in range(n):
        text, bad = rng.choices(words, k=60), int(rng.random() < 0.3)
        for _ in range(4 * bad):
            text.insert(rng.randrange(60), rng.choice(["zzslur", "Zzfoul,", "qqnasty"]))
        docs.append((k, " ".join(text)))
        labels.append((k, bad))
    return docs, labels


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    rows = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) > 0.95 * len(out)


def test_held_out_labels_are_never_learned(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in labels]
    a, b = (toxicity.train(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_nulls_repeats_clashing_columns_and_empty(spark):
    docs, labels = corpus(100)
    frame = spark.createDataFrame([(k, t, 0.5, 1) for k, t in docs] + [(None, docs[0][1], None, 1), (7, None, 1.0, 1), (8, "", 1.0, 1), (8, "", 1.0, 1), (9, "zzslur " * 200_000, 1.0, 0)], "doc_id long, text string, score double, toxic int")
    known = spark.createDataFrame([*labels, (3, None), (None, 1), (4, 9), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(frame, known).collect()
    assert len(rows) == 105 and all(0 <= r.score <= 1 for r in rows)
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert toxicity.toxicity(frame.limit(0), known).count() == 0
    assert {r.score for r in toxicity.toxicity(frame, known.limit(0)).collect()} == {0.5}


def test_the_bound_holds_for_rows(spark):
    docs, labels = corpus(60)
    again = next(k for k, _ in docs if zlib.crc32(str(k).encode()) % 3 != 1)
    frame = spark.createDataFrame(docs + [(again, f"again {k}") for k in range(500)], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.training_rows(frame, known, 50).collect()
    assert len(rows) == 50
    assert toxicity.training_rows(frame.repartition(7), known, 50).collect() == rows


def test_drop_toxic_keeps_columns(spark):
    docs, labels = corpus(150)
    frame = spark.createDataFrame([(t, k, 2.0) for k, t in docs], "text string, doc_id long, score double")
    kept = toxicity.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == frame.columns and 0 < kept.count() < 150
