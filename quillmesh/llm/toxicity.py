"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Per-coordinate learning rates and an L1 penalty leave few nonzero weights; these alone are
broadcast, and every whole text is scored in place: no exchange of texts.

The classifier is fitted on a bounded sample of labelled rows, `MOST_ROWS` of them at most (those
with the least hash of their id), none of a held-out fold. Scoring covers every row.

Words are `[^\\x20\\x09-\\x0D]+` in lower case without outer punctuation. A feature (one word, its
first four or five characters, two or three words in a row, or two with one or two words between)
counts once a text, at a hashed index.

Defined cases: a null or blank text scores the bias; a null doc_id is scored, never learned from and
not held out; repeated rows score alike; of repeated labels the highest counts, other than 0 and 1
none; with no label at all every score is the prior 0.5; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.worker_state import only
from quillmesh.runtime import table

BITS = 22
MOST_ROWS = 10_000
EPOCHS = 3
#: A feature is learned once so many sampled texts have it.
INCLUDED = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.7
BIAS = 1 << BITS
PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
FOLDS, HELD_OUT = 3, 1


class WordHashes:
    """word -> hashes of the word and of its first four and five characters; kept for `limit` words."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit
        self.table = np.zeros((1 << 12, 3), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) + len(missing) > self.limit:
                known.clear()
                missing = list(set(words))
            first = len(known)
            while len(self.table) < first + len(missing):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k, w in enumerate(missing, first):
                known[w] = k
                core = w.strip(PUNCTUATION) or w
                self.table[k] = [xxhash.xxh3_64_intdigest(c.encode("utf-8", "surrogatepass")) for c in (core, "4" + core[:4], "5" + core[:5])]
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd multipliers that tell the places of a feature's words apart.
PLACE = [np.uint64(int.from_bytes(xxhash.xxh64_digest(bytes([k])), "big") | 1) for k in range(6)]
SHIFT = np.uint64(64 - BITS)


def feature_ids(text: str | None) -> np.ndarray:
    """The hashed indices of a text's features; an index may come more than once."""
    rows = only("toxicity", WordHashes).of(WORDS.findall((text or "").lower()))
    h = rows[:, 0]
    one = h * PLACE[0]
    two, three = h[1:] * PLACE[1], h[2:] * PLACE[2]
    pair = one[: len(two)] + two
    x = np.concatenate([
        rows.ravel() * PLACE[0], pair ^ PLACE[1], (pair[: len(three)] + three) ^ PLACE[2],
        (one[: len(h[2:])] + h[2:] * PLACE[3]) ^ PLACE[3], (one[: len(h[3:])] + h[3:] * PLACE[4]) ^ PLACE[4],
    ])
    x ^= x >> np.uint64(31)
    return ((x * PLACE[5]) >> SHIFT).astype(np.int64)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over examples in the given order: (indices, weights), the bias at index BIAS."""
    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    examples = [np.append(np.unique(feature_ids(t)), BIAS).astype(np.int32) for t in texts]
    seen = np.zeros(BIAS + 1, np.int32)
    for i in examples:
        seen[i] += 1
    seen[BIAS] = INCLUDED
    # The included features are numbered by how common they are, so that the busy state stays in cache.
    order = np.flatnonzero(seen >= INCLUDED)
    order = order[np.argsort(-seen[order], kind="stable")]
    number = np.full(BIAS + 1, -1, np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    examples = [k[k >= 0] for k in (number[i] for i in examples)]
    z, n = np.zeros(len(order)), np.zeros(len(order))
    for _ in range(epochs):
        for i, y in zip(examples, labels, strict=True):
            w = weights(i)
            gradient = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum())))) - y
            square = gradient * gradient
            rate = (np.sqrt(n[i] + square) - np.sqrt(n[i])) / ALPHA
            z[i] += gradient - rate * w
            n[i] += square
    found = np.nonzero(np.abs(z) > L1)[0]
    return order[found], weights(found)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(place, text, toxic): at most `most` rows of labelled documents outside the held-out fold, in hash order of ids and texts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)
    # `most` ids and labels: a proven bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "text", "toxic")
    return rows.orderBy("place", F.xxhash64("text"), "text").limit(most)  # an id may have more rows than one


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted in one task on the bounded sample; at most 2^BITS + 1 of them, in truth a few thousand."""

    def learn(batches):
        rows = pd.concat([*batches, pd.DataFrame({"place": [], "text": [], "toxic": []})]).sort_values(["place", "text"], kind="stable")
        found, weights = fit(rows.text.tolist(), rows.toxic.astype(int).tolist()) if len(rows) else ([], [])
        yield pd.DataFrame({"i": np.asarray(found, np.int64), "w": np.asarray(weights, np.float64)})

    got = training_rows(docs, labels, most).repartition(1).mapInPandas(learn, "i long, w double").toPandas().sort_values("i")
    return got.i.to_numpy(np.int64), got.w.to_numpy(np.float64)


def score(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, score) of (row, text) rows, scores from 0 to 1. One pass; the weights are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        index, values = shared.value
        dense = np.zeros(BIAS + 1, np.float32)
        dense[index] = values
        bias = float(dense[BIAS])
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text").to_pylist()):
                i = feature_ids(text)
                i = np.unique(i[dense[i] != 0])
                out[k] = bias + dense[i].sum(dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["row", "score"])

    return rows.select("row", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs.select(F.col("doc_id").alias("row"), "text"), train(docs, labels)).withColumnRenamed("row", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, in docs' own columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = score(rows, train(docs, labels)).where(F.col("score") < THRESHOLD)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
