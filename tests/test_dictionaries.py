import random

import pytest

from quillmesh.operators import dictionaries


def brute(docs, forms, whole):
    inner = lambda c: c.isalnum() or c == "_"
    out = {}
    for i, text in docs:
        low = (text or "").lower()
        for form, canonical in {(f.lower(), c) for f, c in forms if f and c}:
            at = low.find(form)
            while at >= 0:
                end = at + len(form)
                if not whole or not (at > 0 and inner(low[at - 1])) and not (end < len(low) and inner(low[end])):
                    n, first = out.get((i, canonical), (0, at))
                    out[i, canonical] = (n + 1, min(first, at))
                at = low.find(form, at + 1)
    return sorted((i, c, n, at) for (i, c), (n, at) in out.items())


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("size", [(50_000, 32_000_000), (7, 300)])
def test_equals_brute_force(spark, monkeypatch, whole, size):
    monkeypatch.setattr(dictionaries, "PART", size[0])
    monkeypatch.setattr(dictionaries, "BLOCK_CHARS", size[1])
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB_ é1") for _ in range(rng.randrange(1, 5)))
    docs = [(k, "".join(word() + rng.choice(" ,.") for _ in range(30))) for k in range(60)] + [(100, None), (101, ""), (102, "AbAbAb")]
    docs += docs[:3]
    forms = [(word(), f"t{k % 9}") for k in range(60)] + [("aba", "t0"), ("ab", "x"), (None, "y"), ("", "z"), ("ab", None), ("ab", "w")]
    got = dictionaries.occurrences(spark.createDataFrame([(*d, 1) for d in docs], "id long, text string, n int"), spark.createDataFrame(forms, "form string, canonical string"), whole)
    expected = {}
    for d in docs:  # repeated rows count together
        for i, c, n, at in brute([d], forms, whole):
            before = expected.get((i, c), (0, at))
            expected[i, c] = (before[0] + n, min(before[1], at))
    assert sorted(map(tuple, got.collect())) == sorted((i, c, n, at) for (i, c), (n, at) in expected.items())


def test_a_hundred_thousand_terms(spark):
    """The plan doesn't grow with the dictionary; each text meets what it holds."""
    terms = spark.range(100_000).selectExpr("concat('term number ', id) AS canonical", "array(concat('alias', id, 'x')) AS aliases")
    docs = spark.createDataFrame([(1, "Here TERM_number_77 and alias99999x, not alias5"), (2, "nothing")], "id long, text string")
    found = dictionaries.mentions_table(docs, terms)
    assert sorted(map(tuple, found.collect())) == [(1, "term number 7"), (1, "term number 77"), (1, "term number 99999")]
    small = dictionaries.mentions_table(docs, terms.limit(10))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * len(small._jdf.queryExecution().optimizedPlan().toString())


def test_forms(spark):
    terms = spark.createDataFrame([(" Big Tree", ["BT", "big_oak", None]), ("elm", None), (None, ["unnamed"])], "canonical string, aliases array<string>")
    assert sorted(map(tuple, dictionaries.forms_of(terms).collect())) == [("big oak", " Big Tree"), ("big tree", " Big Tree"), ("big_oak", " Big Tree"), ("big_tree", " Big Tree")]


def test_entities_with_context(spark):
    docs = spark.createDataFrame([(1, "the officer Khan came; Khan left"), (2, "Khan " + "x" * 40 + " officer"), (3, "officer" + " y" * 30 + " khan"), (4, "khanate")], "id long, text string")
    forms = spark.createDataFrame([("khan", "Khan", "person"), ("left", "Left", "deed")], "form string, canonical string, type string")
    near = spark.createDataFrame([("officer",), ("the",)], "form string")
    got = sorted(map(tuple, dictionaries.dictionary_entities(docs, forms, near).collect()))
    assert got == [(1, "deed", "Left", 1, 0.8), (1, "person", "Khan", 2, 0.9), (2, "person", "Khan", 1, 0.6), (3, "person", "Khan", 1, 0.6)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "id long, text string")
    forms = spark.createDataFrame([("text", "t")], "form string, canonical string")
    assert dictionaries.occurrences(docs.limit(0), forms).count() == 0 and dictionaries.occurrences(docs, forms.limit(0)).count() == 0
