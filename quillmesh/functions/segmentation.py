"""Word segmentation over a unigram cost table, and deterministic stand-in embeddings."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.runtime import table

#: A dictionary is a parameter; a larger one is refused, not cut.
MOST_WORDS = 200_000


def segment(text: str, costs: dict[str, float], longest: int) -> str:
    """The cheapest cut of a text without spaces into known words; an unknown letter costs 20 more than the dearest word."""
    unknown = max(costs.values(), default=0.0) + 20.0
    best, cut = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = [(best[start] + costs[text[start:end]], start) for start in range(max(0, end - longest), end) if text[start:end] in costs]
        value, start = min([*options, (best[end - 1] + unknown, end - 1)])
        best.append(value)
        cut.append(start)
    words, end = [], len(text)
    while end:
        words.append(text[cut[end] : end])
        end = cut[end]
    return " ".join(reversed(words))


def recover_spaces(frame: DataFrame, column: str, counts: dict[str, int]) -> DataFrame:
    """FN55: adds `recovered`; costs are the negative logarithms of the words' shares."""
    if len(counts) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words")
    total = sum(counts.values())
    shared = frame.sparkSession.sparkContext.broadcast({w: -math.log(n / total) for w, n in counts.items()})
    longest = max(map(len, counts), default=1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)

    def run(batches):
        for rows in batches:
            yield rows.assign(recovered=[None if t is None else segment(t, shared.value, longest) for t in rows[column]])

    return frame.mapInPandas(run, f"{kinds}, recovered string")


@query("fn55_space_recovery")
def fn55(spark, d):
    """Part names whose spaces are gone, cut again with the words of all names as the dictionary."""
    part = table(spark, d, "part", "p_partkey", "p_name")
    rows = part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).limit(MOST_WORDS + 1).collect()
    glued = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("glued"))
    return recover_spaces(glued, "glued", {r["w"]: r["n"] for r in rows}).select("p_partkey", "recovered")


def stand_in(text: str, dims: int = 384) -> np.ndarray:
    """FN18: a unit vector of normal numbers seeded by the text's MD5: the same text always gives the same one."""
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest(), "big"))
    v = rng.standard_normal(dims)
    return (v / np.linalg.norm(v)).astype(np.float32)


@query("fn18_stand_in_embeddings")
def fn18(spark, d):
    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"item_id": rows.item_id, "embedding": [stand_in(t or "", 64).tolist() for t in rows.text]})

    return table(spark, d, "benchmark", "item_id", "text").mapInPandas(run, "item_id long, embedding array<float>")
