"""What the review of round 3 found: each of these failed before."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmesh.functions import records, scoring, text
from quillmesh.operators import aggregates, clusters, components, dictionaries, graph, joins, matching, ranking, token_sets, vector_index
from quillmesh.sources import packages, pdf


#: (temperature, k, risk): a product with 0.8 lifts these over a half.
CASES = [(18.38, 3, 42.0), (3.38, 3, 33.0), (19.14, 34, 37.0)]


def test_fire_risk_below_a_half(spark):
    rows = spark.createDataFrame(CASES, "t double, k int, risk double")
    found = rows.select("risk", scoring.fire_risk(rows.t, rows.k, rows.k / 5.0).alias("got")).collect()
    assert [r.got for r in found] == [r.risk for r in found]


def test_intents_end_at_accented_letters(spark, tmp_path):
    spark.createDataFrame([(1, 1, "esé"), (1, 2, "es e"), (1, 3, "es"), (1, 4, "est"), (1, 5, "es_"), (1, 6, "esч")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.turn: r.intent for r in text.fn47(spark, str(tmp_path)).collect()}
    assert found == {1: "list", 2: "list", 3: "list", 4: "other", 5: "other", 6: "list"}


def test_located_rows_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "Ward 1, nation_12 area"), (2, "Ward 1, nation_12 area"), (3, "outside"), (4, None), (5, "nation_1")], "id long, location string")
    places = spark.createDataFrame([("NATION_1", "1", "x", True), ("NATION_12", "12", "y", False)], "place string, district string, division string, special boolean")
    found = matching.located(rows, places)
    assert {r.id: r.place for r in found.collect()} == {1: "NATION_12", 2: "NATION_12", 3: None, 4: None, 5: "NATION_1"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [location" in plan and "BroadcastHashJoin [id" not in plan


def test_ungrounded_terms_are_compared_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["forests", "penalty", "abcdefgh", "forests"], ["forest", "fined", "abcdefgx"]), (2, ["forest"], None), (3, None, ["x"])], "id long, terms array<string>, sources array<string>")
    found = matching.ungrounded_terms(rows)
    assert {r.id: (r.n_terms, r.ungrounded) for r in found.collect()} == {1: (3, []), 2: (1, ["forest"]), 3: (0, [])}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rid" in plan and "BroadcastHashJoin [rid" not in plan


def test_long_texts_are_packed_in_one_pass(spark):
    parts = [f"some words. and the tail {k:04}" for k in range(3000)]
    began = time.monotonic()
    chunks = spark.createDataFrame([(parts,)], "parts array<string>").select(records.packed(F.col("parts"), 16).alias("c")).first().c
    assert time.monotonic() - began < 30
    assert chunks[0] == "\n\n".join(parts[:2]) and chunks[1].startswith("and the tail 0001. some words.") and "\n\n".join(chunks).count("some words") == 3000


def test_later_duplicates_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[7]
    x[200:230] = x[50:80] + 0.1 * rng.normal(size=(30, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(300)
    vectors = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(ids, x, strict=True)] + [(900, None)], "vec_id long, embedding array<double>")
    brute = {int(ids[k]) for k in range(300) if ((x @ x[k] >= 0.99) & (ids < ids[k])).any()}
    assert {r.vec_id for r in ranking.later_duplicates(vectors, 0.99).collect()} == brute and len(brute) > 100


def test_sources_that_override_all_others_are_not_joined(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (3, 0), (3, 9), (4, 2), (4, 0), (4, 1), (None, 0), (None, 1), (5, None), (5, 2)], "grp long, src long")
    found = joins.overriding(rows, {0: [1], 1: [], 2: [0, 1]})
    assert {(r.grp, r.src) for r in found.collect()} == {(1, 0), (4, 2)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_linked_sets_of_crowded_tokens(spark, monkeypatch):
    """Blocks of a token, long runs and sets of thousands of tokens, against all pairs."""
    monkeypatch.setattr(token_sets, "MOST", 8)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(6000)]
    sets = {k: set(rng.choice(base, int(rng.choice([5, 40, 700, 3000])), replace=False)) for k in range(60)}
    for k in range(60, 130):  # near copies, whose first tokens come often
        sets[k] = {w for w in sets[int(rng.choice([2, 3, 5, 7]))] if rng.random() < 0.95}
    rows = spark.createDataFrame([(k, "\t".join(s)) for k, s in sets.items()] + [(900, " \n"), (901, None), (902, "a\x0bb c"), (903, "a b c")], "id long, text string").repartition(3)
    heads = [k for k in sets if all(sets[k] != sets[j] for j in range(k))]  # equal sets meet as one
    brute = {(a, b): len(sets[a] & sets[b]) for a in heads for b in heads if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    sketched, links = token_sets.linked_sets(rows, token_sets.hashed_words, 0.8, True)
    assert {(r.a, r.b): r.common for r in links.collect()} == brute and len(brute) > 100
    assert {r.id: r.n for r in sketched.collect()} == {k: len(s) for k, s in sets.items()} | {902: 2, 903: 3}


def test_linked_sets_move_few_bytes_a_token(spark):
    """A set that is like no other leaves no token behind: only its head is met, and its tokens stay where they are."""
    rows = spark.createDataFrame([(k, " ".join(f"t{k}x{j}" for j in range(400))) for k in range(40)], "id long, text string")
    sketched, links = token_sets.linked_sets(rows, token_sets.hashed_words, 0.8, True)
    assert links.count() == 0 and sketched.select(F.sum(F.size("tokens"))).first()[0] < 40 * 4


def test_page_batches_are_cut_from_a_stream(spark):
    """Batches over the ends of Arrow batches, and documents without an id; no group of its own is sent for a batch."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, p, f"{k}-{p}") for k in range(9) for p in range(k + 1)] + [(None, p, f"n-{p}") for p in range(12)]
        pages = spark.createDataFrame(rows, "id long, page int, text string").repartition(4)
        found = packages.in_page_batches(pages, 5, lambda p: pd.DataFrame({"text": ["|".join(p["text"])]}), "text string")
        names = [(str(k), k + 1) for k in range(9)] + [("n", 12)]
        assert sorted(r.text for r in found.collect()) == sorted("|".join(f"{n}-{p}" for p in range(a, min(a + 5, z))) for n, z in names for a in range(0, z, 5))
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_texts_are_read_through_the_automaton_as_they_come(spark):
    docs = spark.createDataFrame([(k, f"Aba number{k} aba") for k in range(50)] + [(None, "an aba")], "id long, text string").repartition(3)
    found = dictionaries.occurrences(docs, spark.createDataFrame([("aba", "A"), ("number7", "B")], "form string, canonical string"), whole_words=True)
    assert {tuple(r) for r in found.collect()} == {(k, "A", 2, 0) for k in range(50)} | {(7, "B", 1, 4), (None, "A", 1, 3)}
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()


def test_unlike_vectors_are_not_moved(spark, monkeypatch):
    """Texts that share a few rare words are no candidates; those that are move once for each pair of blocks, not once a pair."""
    moved = []
    in_pairs = matching.in_pairs
    monkeypatch.setattr(matching, "in_pairs", lambda rows, *keys: moved.append(rows.count()) or in_pairs(rows, *keys))
    unlike = [(k, " ".join([f"rare{(k + j) % 40}" for j in range(2)] + [f"word{k}x{j}" for j in range(60)])) for k in range(40)]
    alike = [(100 + k, " ".join([f"same{j}" for j in range(60)] + [f"own{k}"])) for k in range(30)]
    found = {r.doc_id: r.cluster for r in matching.tfidf_clusters(spark.createDataFrame(unlike + alike + [(900, None)], "doc_id long, text string")).collect()}
    assert found == {k: k for k, _ in unlike} | {k: 100 for k, _ in alike} and moved == [30]


def test_edges_of_a_hub_stay_where_they_are(spark, monkeypatch):
    """The edges of a hub aren't joined by their node: they are told by a broadcast of the few hubs."""
    monkeypatch.setattr(components, "CROWDED", 20)
    edges = spark.createDataFrame([(k, 0) for k in range(1, 200)] + [(300 + k, 200 + k) for k in range(30)] + [(230, 229), (500, 499), (499, 5)], "src long, dst long").repartition(3)
    large, least = components._large_star(edges, edges.count())
    assert {tuple(r) for r in least.where("n > 20").select("node", "m").collect()} == {(0, 0)}
    assert {tuple(r) for r in large.collect()} == {(k, 0) for k in range(1, 200)} | {(300 + k, 200 + k) for k in range(30)} | {(230, 229), (500, 5), (499, 0)}
    assert "BroadcastHashJoin" in large._jdf.queryExecution().executedPlan().toString()
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert {found[k] for k in [*range(200), 499, 500]} == {0} and found[329] == found[230] == 229 and found[300] == 200


def test_events_of_a_place_and_time_are_one_unit(spark, monkeypatch):
    """Components of events equal all pairs; links are between units of a place and time, so a place of many events has few."""
    linked = []
    monkeypatch.setattr(graph, "components", lambda links: linked.append(links.count()) or components.components(links))
    rng = np.random.default_rng(4)
    n = 400
    spots = np.round(rng.uniform(0, 1.0, size=(14, 2)), 3)
    at = np.where(rng.random(n) < 0.5, rng.integers(0, 40 * 86400, n), rng.integers(0, 9, n) * 259200)
    place = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 14, n))
    rows = [(int(k), pd.Timestamp("2024-01-01") + pd.Timedelta(int(at[k]), "s"), float(30 + spots[place[k], 0]), float(70 + spots[place[k], 1])) for k in range(n)]
    rows += [(900, pd.Timestamp("2025-01-01"), 30.0, 70.0), (901, None, 30.0, 70.0)]
    lat, lon = (np.radians([r[c] for r in rows]) for c in (2, 3))
    when = np.array([np.nan if r[1] is None else r[1].timestamp() for r in rows])
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    paired = set()
    for a in range(len(rows)):
        h = np.sin((lat - lat[a]) / 2) ** 2 + np.cos(lat) * np.cos(lat[a]) * np.sin((lon - lon[a]) / 2) ** 2
        for b in np.flatnonzero((2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 10.0) & (np.abs(when - when[a]) <= 6 * 3600)).tolist():
            if a != b:
                paired |= {a, b}
                root[max(top(a), top(b))] = min(top(a), top(b))
    events = spark.createDataFrame([(r[0], None if r[1] is None else r[1].to_pydatetime(), *r[2:]) for r in rows], "id long, ts timestamp_ntz, lat double, lon double").withColumn("ts", F.col("ts").cast("timestamp"))
    found = {r.id: r.cluster for r in graph.near_clusters(events, 10.0, 6.0).collect()}
    assert found == {rows[k][0]: rows[top(k)][0] for k in paired} and 2 < len(set(found.values()))
    linked.clear()
    many = spark.range(5000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3600).alias("ts"), F.lit(30.0).alias("lat"), F.lit(70.0).alias("lon"))
    assert graph.near_clusters(many, 10.0, 72.0).select("cluster").distinct().count() == 1 and linked[0] <= 3


def test_small_groups_are_clustered_without_rounds(spark, monkeypatch):
    """Groups of few places take no rounds, and all get the rows that rounds give."""
    rng = np.random.default_rng(6)
    rows = [(k, float(30 + rng.integers(0, 300) / 1000), float(70 + rng.integers(0, 300) / 1000), None if k % 11 == 0 else int(rng.integers(0, 4)) + 9 * (k % 2)) for k in range(700)]
    events = spark.createDataFrame(rows, "id long, lat double, lon double, source long").repartition(3)
    rounds = {tuple(r) for r in clusters.greedy_seed_clusters(events, "source", 10.0, 0, 0).collect()}
    met = []
    seeds = clusters.greedy_seeds
    monkeypatch.setattr(clusters, "greedy_seeds", lambda places, *more: met.append(places.count()) or seeds(places, *more))
    assert {tuple(r) for r in clusters.greedy_seed_clusters(events, "source", 10.0).collect()} == rounds and not met and len(rounds) == 700
    assert {tuple(r) for r in clusters.greedy_seed_clusters(events, "source", 10.0, 0, 80).collect()} == rounds and 80 < met[0] < 700


def test_word_documents_of_one_split_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packages, "TASK_FILES", 50)
    spark.range(400).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'s' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = packages.src5b(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.c_custkey, r.position, r.text) for r in found} == {(k, p, t) for k in range(400) for p, t in ((0, f"n{k}"), (1, "s"))} and len({r.task for r in found}) == 8


def test_inverted_file_scores_blocks(spark, monkeypatch):
    """With all cells probed the search equals brute force over blocks and copies, and pairs leave no task."""
    monkeypatch.setattr(vector_index, "CODE_BLOCK", 40)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[100:150] = x[20]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ranking.ivf_search(vectors, vectors.where("vec_id % 10 = 0"), 4, 4, 5)
    score = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 6)
    brute = {(q, v, n + 1) for q in range(0, 200, 10) for n, v in enumerate(sorted((v for v in range(200) if v != q), key=lambda v: (-score[q, v], v))[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == brute
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()


def test_pdf_fonts_are_read_once_a_file(spark, tmp_path, monkeypatch):
    """The map of a font that all pages use is read once, not once a page; few splits hold no task back."""
    read = []
    monkeypatch.setattr(pdf, "unicode_map", lambda data, real=pdf.unicode_map: read.append(1) or real(data))
    pages = [[f"page {k}", "ünïcödé 𝄞 日本"] for k in range(30)]
    assert [t for _, t, _ in pdf.pdf_text(pdf.pdf_bytes(pages, True))] == ["\n".join(p) for p in pages]
    assert len(read) == 1
    spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pdf, "DOCUMENTS_A_TASK", 10)
    pages = pdf.src6(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == 4 and {(r.doc_id, r.page, r.text) for r in pages.collect()} == {(k, 0, f"text {k}") for k in range(40)}


def test_pdf_strings_read_whole_as_by_code():
    """Strings of one size of code are read at once: the same texts and, to the last bit, widths as code by code."""
    font = pdf.Font(pdf.Pdf(pdf.pdf_bytes([["ab c"]], False)), {"FirstChar": 97, "Widths": [333, 251.7]})
    for double, codes in ((False, b"a b\xff ab"), (False, b""), (True, b"\x00a\x00 \x01b"), (True, b"\x00a\x00")):
        font.sizes, font.double = [2] if double else [1], double
        again = pdf.Font.__new__(pdf.Font)
        again.__dict__ |= font.__dict__
        again.keep()
        width, texts = 0.0, []
        for text, wide, space in again.read(codes):
            texts.append(text)
            width += (wide / 1000 * 9.7 + 0.3 + 1.1 * space) * 0.9
        assert again.line(codes, 9.7, 0.3, 1.1, 0.9) == ("".join(texts), width)


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """Edges that one task may hold are contracted there: no round, and so no plans and stages of rounds on the driver. More of them go by rounds first."""
    rounds = []
    monkeypatch.setattr(components, "_small_star", lambda edges, real=components._small_star: rounds.append(1) or real(edges))
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 200), (300, 301)], "src long, dst long").repartition(4)
    expected = {k: 0 for k in range(101)} | {200: 200, 300: 300, 301: 300}
    assert {r.node: r.component for r in components.components(edges).collect()} == expected and not rounds
    monkeypatch.setattr(components, "EDGES", 5)
    assert {r.node: r.component for r in components.components(edges).collect()} == expected and rounds


def test_best_classes_are_those_of_a_whole_sort():
    rng = np.random.default_rng(5)
    for size in (1, 7, 40, 300):
        near, n = rng.integers(0, 12, size) / 4, rng.integers(1, 5, size)
        for keep in (1, 5, 40, 2000):
            order = np.argsort(-near, kind="stable")
            whole = order[: int(np.searchsorted(np.cumsum(n[order]), keep)) + 1]
            assert vector_index.best_first(near, n, keep).tolist() == whole.tolist()


def test_pairs_of_chunks_are_dealt_by_their_number(spark, monkeypatch):
    """However few partitions a session shuffles to, a task holds about PAIRS pairs."""
    members = spark.createDataFrame([(c, v) for c in range(20) for v in range(c, c + 4)], "c long, v long")
    monkeypatch.setattr(aggregates, "PAIRS", 50)
    found = aggregates.neighbour_counts(members)
    assert "hashpartitioning(v#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 5), REPARTITION_BY_NUM" in plan
    assert {r.v: r.degree for r in found.collect()} == {v: len({w for c in range(20) for w in range(c, c + 4) if c <= v < c + 4} - {v}) for v in range(23)}
