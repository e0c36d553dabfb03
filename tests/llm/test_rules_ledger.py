from pyspark.sql import functions as F

from quillmesh.llm import quality_rules as q


def test_measurements_and_repeats(spark):
    words = " ".join(f"w{k}" for k in range(12))
    rows = [(1, words), (2, words + " x " + words), (3, None), (4, " \n\t"), (5, "a\na\nb\n\n a\na"), (6, "#*$ %&|<> x"), (7, "é" * 5 + " ß"), (8, "x " * 40), (8, "x " * 40)]
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted(q.ledger(frame).collect(), key=lambda r: r.doc_id)
    by = {r.doc_id: r for r in got}
    assert len(got) == 9
    assert by[1].n_repeat_words == 0 and by[2].n_repeat_words == 24 and by[8].n_repeat_words == 40
    assert (by[3].n_words, by[3].word_chars, by[3].n_dup_lines, by[4].n_words) == (0, 0, 0, 0)
    assert by[5].n_dup_lines == 2 and by[5].n_lines == 5
    assert (by[6].n_symbols, by[6].n_words, by[6].n_bare_words) == (8, 3, 2) and (by[7].word_chars, by[7].n_words) == (6, 2)
    assert q.ledger(frame.limit(0)).count() == 0


def test_overlapping_windows_count_each_word_once(spark):
    a = " ".join("abcdefghijkl")
    row = q.ledger(spark.createDataFrame([(1, f"{a} Z {a} Y " + " ".join("cdefghij"))], "doc_id long, text string")).first()
    assert row.n_repeat_words == 12 + 12 + 8


def test_policies_and_ablation_equal_a_plain_count(spark):
    docs = [(k, t) for k, t in enumerate(["good words " * 3 + " ".join(f"word{j}" for j in range(40)), "x", "| " * 60, "# # word " * 30, "ab " * 100, "\n".join(["same line here"] * 30)])]
    entries = q.ledger(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = q.apply_policy(entries).collect()
    assert [r.kept for r in sorted(rows, key=lambda r: r.doc_id)] == [r.failed_bits & q.mask_of("v1") == 0 for r in sorted(rows, key=lambda r: r.doc_id)]
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in q.ablate(entries).collect()}
    mask = q.mask_of("v1")
    for rule in q.POLICIES["v1"]:
        bit = q.BIT[rule]
        bits = [r.failed_bits & mask for r in rows]
        assert found[rule] == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    base = entries.where(F.col("failed_bits").bitwiseAND(F.lit(q.mask_of("base"))) != 0)
    assert base.where("NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)").count() == 0
