import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np

from quillmesh.llm import suffix_dedup


def brute(docs):
    datas = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + 200] for b in datas.values() for i in range(len(b) - 199))
    out = {}
    for d, b in datas.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéßñ", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (20, 36, 38, 40, 45, 80, 300)]
    docs = [(k, prose(rng.choice([1, 30, 60, 300]))) for k in range(60)]
    docs += [(100 + k, prose(rng.randint(0, 40)) + " " + rng.choice(passages) + " " + prose(rng.randint(0, 40)) + rng.choice(["", rng.choice(passages)])) for k in range(80)]
    base = prose(200)
    for k in range(40):
        w = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        docs.append((300 + k, " ".join(w)))
    docs += [(400 + k, docs[k][1]) for k in range(0, 60, 4)]
    docs += [(500, "a" * 199), (501, "a" * 200), (502, "b" * 201), (503, "ab" * 500), (504, ("line of text\n") * 100), (505, None), (506, "")]
    docs += [(507, passages[-1][:200]), (508, passages[-1][5:204]), (509, passages[-1][5:205])]
    return docs


def got(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_equals_brute_force(spark):
    docs = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute(docs)
    assert got(suffix_dedup.suffix_dedup(frame).collect()) == expected


def test_crowded_names_equal_brute_force(spark):
    docs = made(7)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(suffix_dedup.suffix_dedup(frame, group=6).collect()) == brute(docs)


def test_one_name_with_many_contexts(spark):
    """Passages that agree on a part of what stands around one core: names are split until small, whole windows are counted."""
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    core, before, behind = letters(120), letters(300), letters(300)
    docs = []
    for k in range(300):
        p, q = rng.choice([0, 5, 20, 60, 100, 250]), rng.choice([0, 5, 20, 60, 100, 250])
        docs.append((k, letters(200 - rng.randint(0, 150)) + before[len(before) - p :] + core + behind[:q] + letters(200)))
    docs += [(1000 + k, t) for k, t in docs[:30]] + [(2000 + k, "x" + t[50:]) for k, t in docs[:30]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    expected = brute(docs)
    for group in (2, 40):
        assert got(suffix_dedup.suffix_dedup(frame, group=group).collect()) == expected


def test_split_names_are_small(spark):
    rng = random.Random(5)
    bits = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    core, group = bits(64), 25
    left, right = [bits(136) for _ in range(3)], [bits(136) for _ in range(3)]
    rows = []
    for k in range(400):  # sample at 136 of a context of 336 bytes, agreement of unlike lengths on both sides
        p, q = rng.randint(0, 136), rng.randint(0, 136)
        context = bits(136 - p) + rng.choice(left)[136 - p :] + core + rng.choice(right)[:q] + bits(136 - q)
        rows.append((bytes([k // 256, k % 256]), 136, 0, context))
    found = spark.createDataFrame(rows, "digest binary, at long, lo long, context binary")
    small, spans = suffix_dedup.split_names(found, group)
    assert small.groupBy("name").count().agg({"count": "max"}).first()[0] <= group
    reached = {(bytes(r.digest), k) for r in spans.collect() for k in range(r.begin, r.end - 199)}
    reached |= {(bytes(r.digest), k) for r in suffix_dedup.gathered_spans(small).collect() for k in range(r.begin, r.end - 199)}
    seen = Counter(c[k : k + 200] for _, _, _, c in rows for k in range(137))
    assert reached == {(d, k) for d, _, _, c in rows for k in range(137) if seen[c[k : k + 200]] > 1}


def test_memory_of_one_name():
    """10,000 contexts of one name, sorted in one task."""
    rng = random.Random(1)
    core = bytes(rng.choices(b"abcdefgh ", k=200))
    contexts = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 136))) for _ in range(10_000)]
    contexts = [(c + core + bytes(rng.choices(b"abcdefgh ", k=136 - len(c)))) for c in contexts]
    tracemalloc.start()
    spans = suffix_dedup.repeated_windows(contexts, np.zeros(len(contexts), np.uint64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400e6, most
    assert len(spans) >= len(contexts)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=3 * suffix_dedup.PIECE))
    cut = suffix_dedup.PIECE - 150
    docs = [(1, text), (2, "x" + text[cut : cut + 400] + "y"), (3, text[2 * cut : 2 * cut + 260])]
    assert got(suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute(docs)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    long = " ".join("t%d" % k for k in range(100))
    frame = spark.createDataFrame([(1, long, 5, 0), (1, long, 5, 0), (None, long, 5, 0), (None, None, 5, 0), (2, "é" * 150 + long[:80], 5, 0)], "doc_id long, text string, n_bytes int, n_chars long")
    rows = suffix_dedup.suffix_dedup(frame).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows) == [(-1, 0, 0), (-1, len(long), len(long)), (1, len(long), len(long)), (1, len(long), len(long)), (2, 380, 300)]
    left = suffix_dedup.remove_repeats(frame)
    assert left.columns == frame.columns and left.count() == 5
    assert suffix_dedup.suffix_dedup(frame.limit(0)).count() == 0


def test_removed_text_in_whole_characters(spark):
    docs = made()
    frame = spark.createDataFrame([(d, t, len(t or "")) for d, t in docs], "doc_id long, text string, n_chars long")
    expected = brute(docs)
    for r in suffix_dedup.remove_repeats(frame).collect():
        text = r.text or ""
        n_bytes, removed, spans, digest = expected[r.doc_id]
        assert n_bytes - removed <= len(text.encode()) <= n_bytes - removed + 2 * spans and "�" not in text
        assert r.n_chars == len(text) or r.text is None
