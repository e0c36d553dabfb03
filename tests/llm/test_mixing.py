import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import mixing

WORD = re.compile(mixing.WORD)


def brute_targets(sizes, weights, most=mixing.MOST):
    """All sizes shared by weight, the excess over `most` times a size shared again, in fractions."""
    out, rest, active = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), [k for k, s in enumerate(sizes) if s]
    while active:
        total = sum(weights[k] for k in active)
        over = [k for k in active if rest * weights[k] > total * most * sizes[k]]
        for k in over or active:
            out[k] = Fraction(most * sizes[k]) if over else rest * weights[k] / total
        rest -= sum(out[k] for k in over)
        active = [k for k in active if k not in over] if over else []
    return [float(x) for x in out]


def test_targets_reshare_what_capped_sources_cannot_take(spark):
    rng = random.Random(3)
    cases = [([10, 10, 10], [1, 2, 3]), ([100, 1, 100], [1, 5, 1]), ([0, 5], [1, 1]), ([], []), ([7], [2])]
    cases += [([rng.choice([0, 1, 10, 100, 10**6, 10**12]) * rng.randint(1, 9) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)]) for n in (2, 5, 9, 30)]
    for sizes, weights in cases:
        frame = spark.createDataFrame([(k, s, w) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))], "k int, size long, weight long")
        assert [r.target for r in mixing.with_targets(frame).orderBy("k").collect()] == pytest.approx(brute_targets(sizes, weights), rel=1e-15)


def test_permutation_is_one_and_reruns_agree():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        once = mixing.permuted(np.arange(n), n, 7)
        assert sorted(once) == list(range(n)) and (once == mixing.permuted(np.arange(n), n, 7)).all()
    assert (mixing.permuted(np.arange(1000), 1000, 7) != mixing.permuted(np.arange(1000), 1000, 8)).any()


def test_a_split_is_a_multinomial_draw():
    for slots, shards in ((0, 5), (1, 1), (7, 1000), (70_000, 13), (5000, 64)):
        names, widths, counts = mixing.split(slots, shards, 1, 4)
        assert counts.sum() == slots and (counts > 0).all() and (widths == 1).all() and len(set(names)) == len(names) and all(0 <= n < shards for n in names)
        again = mixing.split(slots, shards, 1, 4)
        assert (again[0] == names).all() and (again[2] == counts).all()
    whole = np.zeros(13)
    for k in range(400):
        names, _, counts = mixing.split(130, 13, 2, k)
        whole[names] += counts
    assert abs(whole / 400 - 10).max() < 1


def test_a_split_never_takes_more_than_a_shard_owns():
    for slots, shards, places in ((400, 7, 400), (399, 7, 400), (3, 10, 5), (500, 3, 1000), (0, 4, 9)):
        names, _, counts = mixing.split(slots, shards, 1, 4, places=places)
        assert counts.sum() == slots and all(c <= mixing.owned(n, 1, shards, places) for n, c in zip(names.tolist(), counts.tolist(), strict=True))
    assert sum(mixing.owned(k, 1, 7, 400) for k in range(7)) == 400


def brute_slots(slots, blocks, shards, source, seed):
    """The plan replayed one slot at a time: (shard, slot, block)."""
    out, whole = [], slots - slots % blocks
    for own, places in ((whole, 0), (slots % blocks, blocks)):
        trees = mixing.split(own, shards, seed, source, stop=mixing.SUBTREE, places=places)
        before = 0
        for low, width, n in zip(*(c.tolist() for c in trees), strict=True):
            number = before
            for shard, _, count in zip(*(c.tolist() for c in mixing.split(n, shards, seed, source, low, width, places=places)), strict=True):
                for k in range(count):
                    slot = whole + shard * blocks // shards + k if places else number
                    number += 1
                    out.append((shard, slot, int(mixing.permuted(np.array([slot % blocks]), blocks, seed * 1_000_003 + source * 101 + slot // blocks)[0])))
            before += n
    return sorted(out)


@pytest.mark.parametrize("subtree", [1, 2, 1 << 14])
def test_slots_take_every_block_before_any_again(spark, monkeypatch, subtree):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 500)
    monkeypatch.setattr(mixing, "RUN", 70)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 300)
    monkeypatch.setattr(mixing, "SUBTREE", subtree)
    plan = [(0, 1000, 400), (1, 3, 9), (2, 900, 900), (3, 0, 5), (4, 1, 1)]
    mix = mixing.Mix(spark.createDataFrame(plan, "source_id long, slots long, blocks long"), 0, 1904)
    found = mixing.slot_blocks(mix)
    assert found.rdd.getNumPartitions() == 7
    rows = found.collect()
    for source, slots, blocks in plan:
        own = [r for r in rows if r.source_id == source]
        assert sorted((r.shard, r.slot, r.block) for r in own) == brute_slots(slots, blocks, mix.shards, source, mixing.SEED)
        assert len(own) == slots == len({r.slot for r in own})
        times = Counter(r.block for r in own)
        assert set(times) <= set(range(blocks)) and max([times[k] for k in range(blocks)]) - min([times[k] for k in range(blocks)]) <= 1
    shards = Counter(r.shard for r in rows)
    assert set(shards) == set(range(4)) and max(shards.values()) < 600


def test_another_draw_takes_other_words(spark, sf_dir, monkeypatch):
    """The permutations stay as they are; only the shards' counts are drawn anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 100")
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 20)
    taken = {r.doc_id: r.taken for r in mixing.mix_taken(docs).collect()}
    drawn = mixing.split
    monkeypatch.setattr(mixing, "split", lambda slots, shards, seed, *a, **b: drawn(slots, shards, seed + 1, *a, **b))
    other = {r.doc_id: r.taken for r in mixing.mix_taken(docs).collect()}
    assert other != taken and abs(sum(other.values()) - sum(taken.values())) <= 64 * 20


def test_sources_of_any_number(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id) AS source", "repeat('w ', cast(1 + id % 5 AS int)) AS text")
    rows = mixing.mix_taken(docs).collect()
    assert len(rows) == 3000 and all(r.taken <= 3 * r.size for r in rows)
    order = sorted(rows, key=lambda r: r.source.encode())
    assert [r.target for r in order] == pytest.approx(brute_targets([r.size for r in order], [1 + k % 3 for k in range(3000)]), rel=1e-15)


def test_clashing_columns_of_documents(spark):
    names = ["rid", "size", "ranges", "row", "start", "block", "taken", "source_id", "text_key", "_key", "_bytes", "_score", "_text", "digest", "n", "score", "own_id", "c"]
    docs = spark.createDataFrame([(k, "x y z " * (k + 1), "a", 1, *[7] * len(names)) for k in range(20)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    assert {tuple(r)[4:] for r in mixed.collect()} == {(7,) * len(names)}


def test_query_on_all_documents(spark, sf_dir):
    rows = mixing.op4_source_mix(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 3 * r.size
        source = docs[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    order = sorted(sizes, key=lambda s: s.encode())
    expected = brute_targets([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))])
    for s, t in zip(order, expected, strict=True):
        assert abs(target[s] - t) <= 1e-9 * t and abs(taken[s] - t) <= mixing.BLOCK
    again = mixing.op4_source_mix(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_nulls_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", 0), (2, "x " * 500, None, 0), (3, "y " * 300, "b", 0), (3, "y " * 300, "b", 0), (None, "z\x0bz", "a", 0), (4, " \n", "c", 0)],
        "doc_id long, text string, source string, target int",
    )
    rows = mixing.mix_taken(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in rows) == [(-1, 2), (1, 0), (2, 500), (3, 300), (3, 300), (4, 0)]
    assert all(r.taken <= 3 * r.size for r in rows)
    assert {r.source_size for r in rows if r.source is None} == {500}
    assert mixing.mix_taken(docs.limit(0)).count() == 0


def test_mixed_documents_and_shards_hold_the_taken_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    taken = {r.doc_id: r.taken for r in mixing.mix_taken(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    words, texts = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        own = WORD.findall(r.text)
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text)
        whole = WORD.findall(texts[r.doc_id])
        assert not Counter(own) - Counter(whole)
    assert dict(words) == {d: n for d, n in taken.items() if n}
    shards = mixing.mix_shards(docs)
    assert shards.select(F.sum(F.size(F.split("words", " ")))).first()[0] == sum(taken.values())
    assert mixing.mix_documents(docs.limit(0)).count() == 0
