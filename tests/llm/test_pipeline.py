import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quillmesh.llm import mixing, near_dup, packing, suffix_dedup, toxicity
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_packing import check_packing
from tests.llm.test_suffix_dedup import brute as suffix_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_inputs(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, out)
        docs = out

    given, kept = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in (given, kept))
    assert after <= before and len(before - after - toxic) <= 0.02 * len(before)

    given, kept = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    heads = {c for _, _, _, c in near_brute(rows).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads)

    given, kept = seen["suffix_dedup"]
    expected = suffix_brute([(r.doc_id, r.text) for r in given.collect()])
    for r in kept.collect():
        n_bytes, removed, spans, _ = expected[r.doc_id]
        assert n_bytes - removed <= len(r.text.encode()) <= n_bytes - removed + 2 * spans

    given, kept = seen["source_mix"]
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in given.collect()}
    taken = Counter()
    for r in kept.collect():
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(n <= 3 * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.02 * sum(sizes.values()) + 64 * 20

    given, pieces = seen["packing"]
    texts = {k: r.text for k, r in enumerate(given.orderBy("doc_id", "text").collect())}
    assert pieces.agg(F.sum("length")).first()[0] > len(texts)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pieces.where("piece = 0").count() == len(texts)


def test_clashing_columns(spark):
    names = ["rid", "size", "ranges", "row", "own_id", "own_key", "text_key", "kept", "_key", "_id", "n", "c", "node", "digest", "_digest", "_bytes", "copies", "kept_text", "_score", "_text", "score", "place", "a.b"]
    docs = spark.createDataFrame(
        [(k, f"w{k // 2} " * 40 + f"own {k}", "a", 1, *range(len(names))) for k in range(30)] + [(None, None, None, None, *range(len(names)))] * 2,
        "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names),
    )
    labels = spark.createDataFrame([(k, int(k == 3)) for k in range(30)], "doc_id long, toxic int")
    for left in (toxicity.drop_toxic(docs, labels), near_dup.drop_near_duplicates(docs), suffix_dedup.remove_repeats(docs), mixing.mix_documents(docs)):
        assert left.columns == docs.columns and left.dtypes == docs.dtypes
        assert {tuple(r)[4:] for r in left.collect()} == {tuple(range(len(names)))}
    pieces = packing.pack_documents(docs).collect()
    assert len(pieces) == 32


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
