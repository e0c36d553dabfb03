import datetime
import math
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pytest

from quillmesh.llm import quantiles
from quillmesh.runtime import stage


def made(spark, rows):
    return stage(spark.createDataFrame(rows, "stream string, grp string, batch int, x long").repartition(5), "test-rows")


def check(rows, got):
    """All that a contract of ranks can say, against sorted lists; returns the worst share of the rows."""
    lists: dict = {}
    for s, g, b, x in rows:
        for key in ((s, g, b), (s, g, -1)):
            lists.setdefault(key, []).append(x)
    expected = {(*k, i) for k, v in lists.items() if len(v) >= 20 for i in range(1, 20)}
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == expected and len(got) == len(expected)
    last, worst = {}, 0
    for v in lists.values():
        v.sort()
    for r in sorted(got, key=lambda r: r.i):
        v = lists[r.stream, r.grp, r.batch]
        assert r.n == len(v) and r.target == -(-r.i * len(v) // 20) and r.exact_x == v[r.target - 1]
        assert min(20, len(set(v))) <= r.points <= min(len(v), 2000) and v[0] <= r.answer <= v[-1]
        assert (r.n_below, r.n_upto) == (bisect_left(v, r.answer), bisect_right(v, r.answer))
        assert r.rank_error == max(0, r.n_below + 1 - r.target, r.target - r.n_upto) and r.within == (1000 * r.rank_error <= 10 * r.n)
        assert r.answer >= last.get((r.stream, r.grp, r.batch), r.answer)
        last[r.stream, r.grp, r.batch] = r.answer
        worst = max(worst, r.rank_error / r.n)
    return worst


@pytest.mark.parametrize("kind", ["wide", "copies", "sorted", "one"])
def test_against_sorted_lists(spark, kind):
    rng = np.random.default_rng(4)
    x = {"wide": (rng.lognormal(8, 3, 60_000) - 500).astype(int), "copies": rng.integers(0, 30, 60_000), "sorted": np.arange(60_000), "one": np.full(60_000, -7)}[kind].tolist()
    rows = [("s", "hot" if k % 3 else f"g{k % 40}", int(b), v) for k, (v, b) in enumerate(zip(x, rng.integers(0, 3, 60_000), strict=True))]
    rows += [("t", "few", 0, k) for k in range(19)] + [("t", "enough", 1, k) for k in range(20)] + [("t", "long", 1, v) for v in (-(1 << 62), 1 << 62) * 15]
    assert check(rows, quantiles.batch_quantiles(made(spark, rows)).collect()) <= 0.01


def test_trees_chunks_and_levels(spark, monkeypatch):
    """Chunks of few rows, a tree of several rounds: still whole weights and small errors."""
    monkeypatch.setattr(quantiles, "CHUNK", 3000)
    monkeypatch.setattr(quantiles, "FAN", 2)
    rng = np.random.default_rng(9)
    rows = [("s", f"g{int(g)}", 0, int(v)) for g, v in zip(rng.integers(0, 40, 50_000) // 20, rng.standard_normal(50_000) * 1e5, strict=True)]
    assert check(rows, quantiles.batch_quantiles(made(spark, rows)).collect()) <= 0.01


def test_weights_and_errors_of_many_merges():
    """200 summaries of one stream merged one after the other: weights are whole, errors stay small."""
    rng, worst = np.random.default_rng(1), 0
    x = rng.standard_normal(1_000_000).cumsum().astype(np.int64)
    salt = np.arange(1)
    g, level, items = (np.zeros(0, np.int64),) * 3
    for k, part in enumerate(np.split(x, 200)):
        parts = np.zeros(len(part), np.int64)
        g, level, items = quantiles.compacted(np.r_[g, parts], np.r_[level, parts], np.r_[items, part], salt + k)
        assert len(items) <= quantiles.MOST and (1 << level).sum() == 5000 * (k + 1)
    order, exact = np.argsort(items, kind="stable"), np.sort(x)
    reached = np.cumsum(1 << level[order])
    for q in range(1, 100):
        answer = items[order][np.searchsorted(reached, q * 10_000)]
        worst = max(worst, np.searchsorted(exact, answer) + 1 - q * 10_000, q * 10_000 - np.searchsorted(exact, answer, "right"))
    assert worst < 8000


def test_capacities_fit():
    assert all(sum(quantiles.capacities(top)) <= quantiles.MOST for top in range(50))


def test_several_groups_at_a_time_are_what_they_are_alone():
    rng = np.random.default_rng(6)
    g = np.sort(rng.integers(0, 5, 30_000))
    x, salt = rng.integers(0, 10**6, 30_000), np.arange(5) * 7
    together = quantiles.compacted(g, np.zeros_like(g), x, salt)
    for k in range(5):
        at = g == k
        alone = quantiles.compacted(np.zeros(at.sum(), np.int64), np.zeros(at.sum(), np.int64), x[at], salt[k : k + 1])
        assert sorted(zip(*(c.tolist() for c in alone[1:]), strict=True)) == sorted(zip(*(c[together[0] == k].tolist() for c in together[1:]), strict=True))


def tables(spark, folder, clicks, lines, items):
    kinds = {
        "clicks": "click_id long, ts timestamp, client_id long, value double, x long, batch int",
        "sale_lines": "sale_id long, item_id long, vendor_id long, n int", "items": "item_id long, brand string, price double, points int",
    }
    for name, rows in (("clicks", clicks), ("sale_lines", lines), ("items", items)):
        spark.createDataFrame(rows, kinds[name]).write.parquet(f"{folder}/{name}.parquet")


def batch_of(i):
    return zlib.crc32(str(i).encode()) % 16 if i is not None else 0


def test_broken_rows_and_repeats(spark, tmp_path):
    at, nan = datetime.datetime(2024, 1, 1), float("nan")
    clicks = [(k, at, k % 2, k / 7, 1, 1) for k in range(900)] * 2 + [(5000, at, None, 1.0, 1, 1), (5001, at, 1, None, 1, 1), (5002, at, 1, nan, 1, 1), (5003, at, 1, float("inf"), 1, 1), (5004, at, 1, 1e300, 1, 1)]
    clicks += [(None, at, 1, 3.0, 1, 1)] * 40
    lines = [(k, k % 6, k % 3 if k % 5 else None, 1) for k in range(700)] * 3 + [(1, None, 1, 1), (1, 99, 1, 1)]
    items = [(0, "b", 1.005, 1), (1, "b", 2.5, 1), (2, None, 3.0, 1), (3, "c", None, 1), (4, "c", -2.345, 1), (5, "b", 7.0, 1), (5, "b", 7.0, 1), (None, "b", 1.0, 1)]
    tables(spark, tmp_path, clicks, lines, items)
    rows = [("value", str(c), batch_of(k), math.floor(100 * v + 0.5) + 1000 * batch_of(k)) for k, _, c, v, *_ in sorted(set(clicks[:900]))] + [("value", "1", 0, 300)]
    known = {k: (b, p) for k, b, p, _ in items if k is not None and b is not None and p is not None}
    rows += [("price", known[i][0], batch_of(v), math.floor(100 * known[i][1] + 0.5) + 1000 * batch_of(v)) for _, i, v, _ in lines if i in known]
    got = quantiles.op12_quantile_summaries(spark, str(tmp_path)).collect()
    assert check(rows, got) <= 0.01


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert quantiles.op12_quantile_summaries(spark, str(tmp_path)).count() == 0


def test_query_on_the_tables(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    clicks = {r.click_id: r for r in read("clicks")}.values()
    rows = [("value", str(r.client_id), batch_of(r.click_id), math.floor(100 * r.value + 0.5) + 1000 * batch_of(r.click_id)) for r in clicks if r.client_id is not None and r.value is not None]
    items = {r.item_id: r for r in read("items") if r.brand is not None and r.price is not None}
    lines = [(items[r.item_id], batch_of(r.vendor_id)) for r in read("sale_lines") if r.item_id in items]
    rows += [("price", item.brand, b, math.floor(100 * item.price + 0.5) + 1000 * b) for item, b in lines]
    assert check(rows, quantiles.op12_quantile_summaries(spark, sf_dir).collect()) <= 0.01
