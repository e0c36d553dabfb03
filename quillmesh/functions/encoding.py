"""Text encoders that need no trained model."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.runtime import table

WORD = re.compile("[A-Za-z]+")


def hashed_encoder(size: int):
    """GR14: a function of a text column to unit vectors: counts of its words by hash, in `size` places, over their length.

    Stands in for a sentence model, which the box doesn't have. Words are runs of ASCII letters, lower-cased;
    null texts and texts without a word give the zero vector. Hashes are kept for a batch, no longer.
    """

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        places: dict[str, int] = {}

        def one(text: str | None) -> np.ndarray:
            counts = np.zeros(size)
            for word in WORD.findall(text or ""):
                word = word.lower()
                place = places.get(word)
                if place is None:
                    place = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size
                counts[place] += 1
            return counts / max(1.0, float(np.sqrt((counts * counts).sum())))

        return texts.map(one)

    return encode


def encoded(docs: DataFrame, size: int = 64, text_col: str = "text") -> DataFrame:
    """GR14: docs with `embedding`, the hashed word vector of a text."""
    return docs.withColumn("embedding", hashed_encoder(size)(F.col(text_col)))


@query("gr14_hashed_encoding", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), c AS (SELECT doc_id, CAST(('0x' || substr(md5(lower(word)), 1, 8)) AS BIGINT) % 64 AS place, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, CAST(place AS INTEGER) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c")
def gr14(spark, d):
    vectors = encoded(table(spark, d, "documents", "doc_id", "text"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "weight")).where("weight > 0").select("doc_id", "place", F.round("weight", 6).alias("weight"))
