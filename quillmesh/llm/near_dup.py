"""N-gram Jaccard join: MinHash banding on word shingles, links verified on whole shingle sets.

Documents with equal shingle sets are one class; only classes are compared. The join has two steps,
so that no pair is ever emitted:
1. Band buckets connect classes. Inside a bucket (in blocks) signatures are compared, and only
   links that the signature leaves open survive: an estimate of half the signature, which a pair
   at the threshold misses with a chance of under 1e-12. What hangs together is a candidate cluster.
2. Inside each cluster (in blocks of bounded shingle weight) all pairs of classes are verified on
   their whole shingle sets, in exact integers; each class gets its number of links and a root.
Clusters of verified links are the near-duplicate components.

Bands and rows are chosen for the recall wanted at the threshold (`bands_for`).

A shingle is five words in a row (`[^\\x20\\x09-\\x0D]+`, as they stand); a text of one to four words
is one shingle. Defined cases: a null or blank text has no shingle, links with nothing and is kept;
repeated rows are copies, of which one row is kept; rows with a null doc_id take part and stand
behind all others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.blocks import in_pairs, linked_roots, overlaps, runs, with_blocks
from quillmesh.llm.worker_state import only
from quillmesh.operators.components import components
from quillmesh.runtime import stage, table

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
ROWS = 5


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The bands of `rows` rows by which a pair at the threshold is found with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - float(threshold) ** rows))


BANDS = bands_for(THRESHOLD, RECALL)
_rng = np.random.default_rng(0x5EED)
MULTIPLY = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
FOLD = _rng.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    def __init__(self, limit: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            own = set(words)
            if len(known) + len(own) > self.limit:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in own if w not in known)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    h = only("shingles", WordHashes).of((text or "").encode("utf-8", "surrogatepass").split())
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, np.uint64(min(width, len(h))))
        for k in range(min(width, len(h))):
            x = (x ^ (x >> np.uint64(29))) * P + h[k : k + n]
        x = (x ^ (x >> np.uint64(32))) * P
        x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(MULTIPLY), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        low = np.minimum(low, (x[at : at + 512, None] * MULTIPLY + ADD).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (low.reshape(BANDS, ROWS).astype(np.uint64) * FOLD[:, :ROWS]).sum(axis=1, dtype=np.uint64) ^ FOLD[:, ROWS]
        return ((keys ^ (keys >> np.uint64(31))) * P).astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (shingles), digest (of the set), sketch (a byte of each MinHash value), keys (of its bands)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            n, digest, low, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text)
                n.append(len(grams))
                digest.append(xxhash.xxh3_128_digest(grams.tobytes()))
                values = signature(grams) if len(grams) else None
                low.append(None if values is None else (values >> np.uint32(24)).astype(np.uint8).tobytes())
                keys.append(None if values is None else band_keys(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n", "digest", "sketch", "keys"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(sketch, f"doc_id {kind}, text_key long, n int, digest binary, sketch binary, keys array<long>")


def classes(sketched: DataFrame) -> DataFrame:
    """c, digest, first (its first document), copies, n, sketch, keys: a row for each shingle set."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"))
    return (
        sketched.where("n > 0").groupBy("digest")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        .withColumn("c", F.monotonically_increasing_id())
    )


def candidate_clusters(found: DataFrame) -> DataFrame:
    """(node, component): classes that band buckets and signatures connect, two or more together."""
    entries = with_blocks(found.select("c", F.explode("keys").alias("key")), "key", "c")
    most = len(MULTIPLY) // 2

    def read(batch):
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, len(MULTIPLY))
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "c")), sketch]

    def connect(batches):
        src, dst = [], []
        for _, _, _, c, sketch in runs(batches, 3, read):
            roots = linked_roots(len(c), lambda one, others, s=sketch: (s[others] == s[one]).sum(axis=1) >= most)
            linked = roots != np.arange(len(c))
            src.append(c[linked])
            dst.append(c[roots[linked]])
            if len(src) > 1000:
                yield edges_of(src, dst)
                src, dst = [], []
        yield edges_of(src, dst)

    # Only entries of keys that two classes share are given their sketch.
    pairs = in_pairs(entries.join(found.select("c", "sketch"), "c"), "key", "c")
    return components(pairs.mapInArrow(connect, "src long, dst long"))


def edges_of(src: list, dst: list) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *src])), pa.array(np.concatenate([empty, *dst]))], names=["src", "dst"])


def verified_links(found: DataFrame, clusters: DataFrame, docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(c, root, n_links, linked_copies) for each block pair in which a class has links."""
    wanted = found.select(F.col("c").alias("node"), "digest", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "copies", "n")
    members = with_blocks(clusters.join(wanted, "node"), "component", "node", "n")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def grams(batches):
        met: set[int] = set()
        for batch in batches:
            sets, keep = [], []
            for node, text, digest in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "digest")), strict=True):
                own = None
                if node not in met:  # repeated rows of the one document that stands for a class come together
                    own = shingles(text)
                    own = own if xxhash.xxh3_128_digest(own.tobytes()) == digest else None
                keep.append(own is not None)
                if own is not None:
                    sets.append(own.tobytes())
                    met.add(node)
            if len(met) > 500_000:
                met.clear()
            batch = batch.filter(pa.array(keep, pa.bool_()))
            out = [*(batch.column(k) for k in ("node", "component", "_block", "_blocks", "copies")), pa.array(sets, pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["node", "component", "_block", "_blocks", "copies", "grams"])

    # One document a class, its first, brings the text: copies stay where they are.
    with_sets = members.join(texts, (members["text_key"] == texts["text_key"]) & members["first_id"].eqNullSafe(texts["doc_id"]))
    with_sets = with_sets.select("node", "component", "_block", "_blocks", "copies", "digest", "text")
    with_sets = with_sets.mapInArrow(grams, "node long, component long, _block int, _blocks int, copies long, grams binary")
    up, down = threshold.numerator, threshold.denominator

    def read(batch):
        sets = np.empty(batch.num_rows, object)
        sets[:] = [np.frombuffer(b, np.uint64) for b in batch.column("grams").to_pylist()]
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "node", "_block", "copies")), sets]

    def verify(batches):
        for _, i, j, c, block, copies, sets in runs(batches, 3, read):
            once = np.concatenate([[True], c[1:] != c[:-1]])  # repeated rows of one document
            c, block, copies, sets = c[once], block[once], copies[once], sets[once]
            if len(c) < 2:
                continue
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            if not len(left) or not len(right):
                continue
            both = overlaps(list(sets), left, right)
            sizes = np.array([len(s) for s in sets])
            link = both * (up + down) >= up * (sizes[left][:, None] + sizes[right][None, :])
            link &= left[:, None] != right[None, :]
            n, linked = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            n[left] += link.sum(axis=1)
            linked[left] += link @ copies[right]
            if i[0] != j[0]:
                n[right] += link.sum(axis=0)
                linked[right] += link.T @ copies[left]
            whole = np.zeros((len(c), len(c)), bool)
            whole[np.ix_(left, right)] = link
            whole |= whole.T
            roots = linked_roots(len(c), lambda one, others, w=whole: w[one, others])
            out = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (c, c[roots], n, linked)], names=["c", "root", "n_links", "linked_copies"])

    return in_pairs(with_sets, "component", "node").mapInArrow(verify, "c long, root long, n_links long, linked_copies long")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, n_links, n_linked_docs, component_id, kept: a row for every row of docs.

    class_id: the first document with the same shingle set. n_links: other shingle sets at 0.8 or
    more. n_linked_docs: other documents at 0.8 or more, copies counted. component_id: the first
    document that links lead to. kept: it is that document.
    """
    sketched = stage(sketches(docs), "sketches")
    found = stage(classes(sketched), "classes")
    links = stage(verified_links(found, candidate_clusters(found), docs), "links")
    totals = links.groupBy("c").agg(F.sum("n_links").alias("n_links"), F.sum("linked_copies").alias("linked_copies"))
    clusters = components(links.select(F.col("c").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "c")
    linked = clusters.join(found.select("c", "first"), "c")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    known = (
        found.select("c", "digest", "first", "copies")
        .join(totals.join(linked.select("c", "component").join(heads, "component"), "c"), "c", "left")
        .select("digest", "first", "copies", F.coalesce("head", "first").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("linked_copies", F.lit(0)).alias("linked_copies"))
    )
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"))
    rows = sketched.select("doc_id", "text_key", F.when(F.col("n") > 0, F.col("digest")).alias("digest"), own.alias("own"))
    return rows.join(known, "digest", "left").select(
        "doc_id", "text_key",
        F.coalesce("first", "own")["doc_id"].alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked_copies", F.lit(0))).alias("n_linked_docs"),
        F.coalesce("head", "own")["doc_id"].alias("component_id"),
        (F.coalesce("head", "own") == F.col("own")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component, in docs' own columns, whatever their names; rows without words all stay."""
    judged = stage(ngram_jaccard_join(docs), "near-duplicates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    key = [F.col("own_id").eqNullSafe(F.col("doc_id")), F.col("own_key") == F.col("text_key")]
    gone = judged.where(~F.col("kept")).select("doc_id", "text_key").distinct()
    left = rows.join(gone, key, "left_anti")
    # Rows alike in id and text: all carry the verdict, one stays.
    again = judged.where("kept AND n_linked_docs > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    lone = left.join(again, key, "left_anti")
    one = left.join(again, key, "left_semi").groupBy("own_id", "own_key").agg(F.first("row").alias("row"))
    return lone.select("row").unionByName(one.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key")


#: The same in DuckDB: all pairs of shingle sets that share a shingle, links closed by recursion.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
d AS (SELECT doc_id, md5(string_agg(gram, chr(1) ORDER BY gram)) AS digest, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT digest, min(doc_id) AS first, count(*) AS copies, any_value(n) AS n FROM d GROUP BY digest),
cg AS (SELECT c.first AS c, gram FROM c JOIN g ON g.doc_id = c.first),
pairs AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM cg x JOIN cg y ON x.gram = y.gram AND x.c <> y.c GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN c ca ON ca.first = a JOIN c cb ON cb.first = b WHERE 9 * shared >= 4 * (ca.n + cb.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
heads AS (SELECT a, least(a, min(b)) AS head FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links, sum(copies) AS linked FROM links JOIN c ON c.first = b GROUP BY a),
k AS (SELECT digest, first, copies, coalesce(head, first) AS head, coalesce(n_links, 0) AS n_links, coalesce(linked, 0) AS linked
      FROM c LEFT JOIN heads ON heads.a = first LEFT JOIN n ON n.a = first)
SELECT w.doc_id, coalesce(first, w.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
       (coalesce(copies - 1, 0) + coalesce(linked, 0))::BIGINT AS n_linked_docs,
       coalesce(head, w.doc_id) AS component_id, coalesce(head, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN k ON k.digest = d.digest
"""
