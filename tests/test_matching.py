"""Queries without SQL, against brute force on small fixtures."""

import difflib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmesh.functions import records
from quillmesh.operators import matching, trees


def connected(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(ids)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed, n=60, vocabulary=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(vocabulary)]
    out = {}
    for k in range(n):
        if out and rng.random() < 0.5:
            own = rng.choice(list(out.values())).split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.choice([1, 3, 8, 12, 40]))
        out[k + 1] = " ".join(own)
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, text string").repartition(3)


def cosine(x, y):
    dot = sum(x[w] * y[w] for w in x if w in y)
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_similar_sets_equal_all_pairs(spark):
    rows = texts(1)
    sets = {k: frozenset(t.split()) for k, t in rows.items()}
    tokens = spark.createDataFrame([(k, w) for k, s in sets.items() for w in s], "id long, token string")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b): r.common for r in matching.similar_sets(tokens, threshold).collect()}
        assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_tfidf_clusters_equal_brute_force(spark):
    rows = texts(2)
    rows |= {1000 + k: rows[1] for k in range(40)}  # copies are most of all rows: no term is lost
    df, n = Counter(w for t in rows.values() for w in set(t.split())), len(rows)
    bags = {k: {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(t.split()).items()} for k, t in rows.items()}
    got = {r.doc_id: r.cluster for r in matching.tfidf_clusters(frame(spark, rows).withColumnRenamed("id", "doc_id")).collect()}
    assert got == connected(bags, lambda a, b: cosine(bags[a], bags[b]) > 0.85)


def test_near_duplicates_equal_brute_force(spark):
    rows = texts(3, 80)
    rows |= {500: "a short text of mine", 501: "a short text of Mine!", 502: "tiny", 503: "quite short words here and there, a few of them", 504: "quite short words here and there, a few of thex", 505: None, 506: ""}
    norm = {k: re.sub(" +", " ", re.sub("[^a-zà-ÿ0-9 ]", " ", (t or "").lower())).strip() for k, t in rows.items()}
    norm = {k: t for k, t in norm.items() if len(t) >= 10}

    def linked(a, b):
        x, y = norm[a], norm[b]
        if len(x.split()) > 10 and len(y.split()) > 10:
            return len(set(x.split()) & set(y.split())) >= 0.8 * len(set(x.split()) | set(y.split()))
        if len(x.split()) > 10 or len(y.split()) > 10:
            return False
        return x == y or (abs(len(x) - len(y)) <= 5 and sum(p == q for p, q in zip(x, y)) / max(len(x), len(y)) > 0.95)

    got = {r.id: r.kept_id for r in matching.near_duplicates(frame(spark, rows)).collect()}
    assert got == connected(norm, linked)
    assert got[501] == 500 and got[504] == 503


def test_merged_names_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["forest officer", "forest office", "range officer", "chief conservator", "conservator", "deodar", "deodars", "section clerk"]
    names = [(k, rng.choice(base) + rng.choice(["", "s", " of", "x"]), rng.choice(["the north of the valley", "the north of the valleys", "a court", "some court"])) for k in range(50)]
    low = {k: (n.lower(), c.lower()) for k, n, c in names}

    def linked(a, b):
        a, b = max(a, b), min(a, b)
        ratio = lambda i: difflib.SequenceMatcher(None, low[a][i], low[b][i]).ratio()
        return ratio(0) > 0.7 and ratio(1) > 0.7

    got = {r.id: r.merged for r in matching.merged_names(spark.createDataFrame(names, "id long, name string, context string")).collect()}
    assert got == connected(low, linked)
    assert len(set(got.values())) < len(names)


def test_sentences_and_terms_equal_brute_force(spark):
    rng = random.Random(5)
    sources = [f"the {rng.choice(['forest', 'officer', 'permit'])} shall be kept by number {k} of the list" for k in range(6)]
    rows = [(k, ". ".join(rng.choice([*sources, "nothing like it at all, really", "short", "x" * 30]) + rng.choice(["", " now", "!"]) for _ in range(5)), rng.sample(sources, 2)) for k in range(30)]
    rows += [(100, None, ["a"]), (101, "", None), (102, "a sentence that nothing maps to", [])]
    norm = lambda t: re.sub(r"[^\w\s\-]", "", re.sub(r"\s+", " ", t.lower())).strip()
    expected = {}
    for k, text, own in rows:
        parts = [p.strip() for p in re.split(r"[.!?]\s+", text or "") if len(p.strip()) >= 20]
        expected[k] = (len(parts), sum(any(difflib.SequenceMatcher(None, norm(p), norm(s)).ratio() >= 0.7 for s in own or []) for p in parts))
    got = {r.id: (r.n_sentences, r.n_mapped) for r in matching.sentence_sources(spark.createDataFrame(rows, "id long, text string, sources array<string>")).collect()}
    assert got == expected and any(0 < m < n for n, m in got.values())

    terms = spark.createDataFrame([(1, ["forest", "penalties", "tree", "rs"], ["woods", "penaltie", "xx"]), (2, None, None), (3, ["same"], ["same"])], "id long, terms array<string>, sources array<string>")
    got = {r.id: r.ungrounded for r in matching.ungrounded_terms(terms).collect()}
    assert got == {1: ["rs", "tree"], 2: [], 3: []}


def test_ungrounded_terms_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["forest", "forests", "woods", "section", "sections", "sec", "penalty", "penalties", "fine", "timber", "x", "ab", "abc", "imprisonment", "rs.", "rs", ""]
    made = lambda: rng.choice(base) + rng.choice(["", "", "s", "x", "ed"])
    rows = [(k % 50, [made() for _ in range(rng.randrange(6))], [made() for _ in range(rng.randrange(5))]) for k in range(80)] + [(100, [None, "tree"], [None]), (101, None, ["a"])]

    def grounded(term, sources):
        near = any(difflib.SequenceMatcher(None, term, s).ratio() > 0.85 for s in sources)
        return near or any(a in term and b in s for s in sources for x, y in matching.VARIANTS for a, b in ((x, y), (y, x)))

    expected = []
    for k, terms, sources in rows:
        own, known = {t for t in terms or [] if t is not None}, {s for s in sources or [] if s is not None}
        expected.append((k, len(own), sorted(t for t in own if not grounded(t, known))))
    got = matching.ungrounded_terms(spark.createDataFrame([(*r, "x") for r in rows], "id long, terms array<string>, sources array<string>, rid string")).collect()
    assert sorted((r.id, r.n_terms, r.ungrounded) for r in got) == sorted(expected)


def test_packed_paragraphs(spark):
    rng = random.Random(6)
    docs = {k: "\n".join(". ".join("w" * rng.randint(1, 200) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))) for k in range(25)}
    docs |= {100: "x" * 5000, 101: "", 102: "one\ntwo", 103: None}
    got = {}
    for r in records.packed_paragraphs(frame(spark, docs)).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r)
    assert 101 not in got and 103 not in got and got[102][0].text == "one\ntwo" and len(got[100]) == 1
    for k, chunks in got.items():
        assert [c.chunk for c in chunks] == list(range(len(chunks))) and {c.n_chunks for c in chunks} == {len(chunks)}
        paragraphs, joined = docs[k].split("\n"), "\n".join(c.text for c in chunks)
        assert all(p.strip() in joined for p in paragraphs)
        longest = max(map(len, paragraphs)) // 4
        for before, chunk in zip(chunks, chunks[1:]):
            tail = before.text.split(". ")
            assert chunk.text.startswith(tail[-1] if len(tail) > 1 else "")
        # A paragraph, its blank lines, and the sentence carried over are all that may pass the bound.
        assert all(len(c.text) // 4 <= 512 + longest + 2 for c in chunks)


def brute_chunks(parts, most, opening=""):
    """The first chunk, as long as it may be, then those of the rest."""
    text = lambda n: opening + "\n\n".join(parts[:n]) if opening else "\n\n".join(parts[:n]).lstrip("\n")
    n = 1
    while n < len(parts) and (not text(n) or len(text(n)) // 4 + len(parts[n]) // 4 <= most):
        n += 1
    own = [text(n).strip()] if text(n).strip() else []
    return own + (brute_chunks(parts[n:], most, text(n).split(". ")[-1] + ". " if ". " in text(n) else "") if n < len(parts) else [])


def test_chunks_equal_brute_force(spark):
    rng = random.Random(7)
    part = lambda: "".join(rng.choice(["ab", ". ", " ", "c.", "x" * 9]) for _ in range(rng.randrange(0, 9))) if rng.random() > 0.2 else ""
    rows = [(k, [part() for _ in range(rng.randrange(1, 14))]) for k in range(300)]
    found = spark.createDataFrame(rows, "id long, parts array<string>").select("id", records.packed(F.col("parts"), 8).alias("chunks")).collect()
    assert {r.id: r.chunks for r in found} == {k: brute_chunks(parts, 8) for k, parts in rows}


def test_sections_of_chapters(spark):
    long = ["a sentence of some words. and another one"] * 4
    laws = [(1, "Law", [("I", [(1, "Head", ["one", "two"]), (2, "Long head", long), (3, None, None), (4, "Only", None)]), ("II", None), ("III", [(1, "Other", ["x", None])])]), (2, "Empty", []), (3, None, None)]
    schema = "id long, title string, chapters array<struct<title: string, sections: array<struct<number: int, heading: string, paragraphs: array<string>>>>>"
    got = {}
    for r in records.section_chunks(spark.createDataFrame(laws, schema), 16).orderBy("chunk").collect():
        got.setdefault((r.id, r.chapter, r.section), []).append(r.text)
        assert r.law == "Law"
    assert got == {(1, "I", 1): ["Head\n\none\n\ntwo"], (1, "I", 2): brute_chunks(["Long head", *long], 16), (1, "I", 4): ["Only"], (1, "III", 1): ["Other\n\nx"]}


def test_dates_and_circulars_of_odd_texts(spark):
    rows = [("5 مارچ 2001 and 03/04/1999", ["1999-04-03", "2001-03-05"]), ("in 1987", ["1987-01-01"]), ("12-jan-2000, 12 JANUARY 2000", ["2000-01-12", "2000-01-12"]), ("99/99/1999 31.02.2001", []), (None, None), ("", [])]
    got = [r.d if r.d is None else [str(x) for x in r.d] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string").orderBy("i").select(records.all_dates(F.col("text")).alias("d")).collect()]
    assert got == [e for _, e in rows]
    empty = spark.createDataFrame([("",), ("nothing of the kind",), (None,)], "text string").select(records.circular(F.col("text")).alias("c")).select("c.*").collect()
    assert all(r.number is None and r.day is None and r.deadline is None and not r.recipients for r in empty)


def test_tree_depths(spark):
    path = [(k + 1, k) for k in range(10_000)]
    got = {r.node: (r.root, r.depth) for r in trees.tree_depths(spark.createDataFrame(path, "child long, parent long")).collect()}
    assert got == {k: (0, k + 1) for k in range(10_001)}
    odd = [(2, 1), (3, 2), (1, 3), (4, 3), (5, 4), (6, 6), (11, 10), (12, 11), (12, 99), (12, 11), (13, None), (None, 10), (101, 100)]  # a cycle, what hangs below it, a loop
    got = {r.node: (r.root, r.depth) for r in trees.tree_depths(spark.createDataFrame(odd, "child long, parent long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5, 6), (None, None)), 10: (10, 1), 11: (10, 2), 12: (10, 3), 100: (100, 1), 101: (100, 2)}
    assert trees.tree_depths(spark.createDataFrame([], "child long, parent long")).count() == 0
