import random
import re
from collections import defaultdict

import numpy as np

from quillmesh.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text):
    w = WORD.findall(text or "")
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs):
    """id -> (class_id, n_links, n_linked_docs, component_id), by comparing all pairs."""
    sets = {d: gram_set(t) for d, t in docs}
    members = defaultdict(list)
    for d, s in sets.items():
        members[s if s else ("blank", d)].append(d)
    keys = list(members)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = defaultdict(list)
    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if isinstance(x, frozenset) and isinstance(y, frozenset) and len(x & y) * 5 >= 4 * len(x | y):
                links[x].append(y)
                links[y].append(x)
                parent[find(x)] = find(y)
    heads = defaultdict(list)
    for k in keys:
        heads[find(k)].append(min(members[k]))
    return {d: (min(members[k]), len(links[k]), len(members[k]) - 1 + sum(len(members[x]) for x in links[k]), min(heads[find(k)])) for k in keys for d in members[k]}


def near_copies(rng, words, n, edits, start):
    base = rng.choices(words, k=150)
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((start + k, " ".join(own)))
    return out


def made():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 6))) for _ in range(3000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 60, 200])))) for k in range(120)]
    shared = " ".join(rng.choices(words, k=60))
    docs += [(200 + k, shared + " " + " ".join(rng.choices(words, k=80))) for k in range(40)]
    for g in range(8):
        docs += near_copies(rng, words, rng.randint(2, 25), rng.choice([1, 3, 6]), 1000 + 100 * g)
    docs += [(3000 + k, docs[k][1] + " \n") for k in range(0, 60, 3)]
    return docs + [(4000, ""), (4001, " \t"), (4002, None)]


def test_join_equals_brute_force(spark):
    docs = made()
    rows = near_dup.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    expected = brute(docs)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_linked_docs, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    rng = random.Random(9)
    words = ["w%d" % k for k in range(500)]
    docs = near_copies(rng, words, 90, 4, 0)
    import quillmesh.llm.blocks as blocks

    monkeypatch.setattr(blocks.with_blocks, "__defaults__", (None, 16, 2000))
    rows = near_dup.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = brute(docs)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_linked_docs, r.component_id) for r in rows} == expected


def test_nulls_repeats_clashing_columns_and_empty(spark):
    text = " ".join("t%d" % k for k in range(40))
    frame = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (None, "a b", 4), (None, "a b", 4), (6, text + " end", 5), (7, None, 6), (8, "x " * 50000, 7)], "doc_id long, text string, kept int")
    rows = near_dup.ngram_jaccard_join(frame).collect()
    assert len(rows) == 8
    assert sorted((r.doc_id or -1, r.kept, r.n_links, r.n_linked_docs) for r in rows) == [(-1, False, 1, 3), (-1, True, 0, 1), (-1, True, 0, 1), (5, True, 1, 3), (5, True, 1, 3), (6, False, 1, 3), (7, True, 0, 0), (8, True, 0, 0)]
    left = near_dup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 5, 7, 8]
    assert near_dup.ngram_jaccard_join(frame.limit(0)).count() == 0
    assert near_dup.drop_near_duplicates(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(200):
        both, a, b = rng.integers(0, 1 << 63, 800, dtype=np.uint64), *rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
        x, y = (near_dup.signature(np.unique(np.concatenate([both, z]))) for z in (a, b))
        found += bool((near_dup.band_keys(x) == near_dup.band_keys(y)).any()) and (x == y).sum() * 2 >= len(x)
    assert found >= 198
