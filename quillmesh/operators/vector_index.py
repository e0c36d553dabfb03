"""A stored index of unit vectors: cells, product-quantised residuals, exact scores of the best; train, add and search apart.

    model/    centroids of cells and, for each part of a vector, code words of what is left of it in its cell
    entries/  vec_id, code (a byte a part) and the unit vector, in a folder a cell

Training reads at most `most_rows` rows, those whose ids hash least: the one bounded sample here. Every usable row is
added, whenever it comes. Rows of one cell and code are a class: a search scores classes by their codes, cell by cell in
blocks of bounded size, takes the best classes of each query until they hold refine * k rows, and ranks their rows by their
vectors. A class is taken whole, so copies that no code tells apart are all compared; crowded classes are met in blocks, and
only the k best of a block leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.runtime import stage, table, unstage
from quillmesh.sources.files import landing

CELLS, PARTS, WORDS = 16, 8, 256
MOST_ROWS = 20_000
#: Codes (or rows of a class) and queries that one task compares at once.
CODE_BLOCK, QUERY_BLOCK = 8192, 512
#: Classes of more rows are met in blocks, others by a join.
CROWDED = 64
SEED = 3


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, u): usable vectors divided by their length; those that are null, empty, zero or hold null or non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    most = F.array_max(F.transform("_x", F.abs))
    square = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v * v)
    rows = vectors.where((F.size("embedding") > 0) & finite).select("vec_id", x.alias("_x")).withColumn("_most", most).where("_most > 0")
    # Divisors stand beside the components: inside a lambda they would be worked out for each component anew.
    over = lambda x, by: F.zip_with(x, F.array_repeat(by, F.size(x)), lambda v, d: v / d)
    return rows.select("vec_id", over("_x", F.col("_most")).alias("_s")).select("vec_id", over("_s", F.sqrt(square)).alias("u"))


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k means of a bounded sample."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    middle = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, middle)
        n = np.bincount(at, minlength=len(middle))
        sums = np.stack([np.bincount(at, weights=c, minlength=len(middle)) for c in x.T], axis=1)
        middle = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], middle)
    return middle


def _nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (middle * middle).sum(axis=1)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (norms - 2 * x[k : k + 4096] @ middle.T).argmin(axis=1)
    return out


def train_index(vectors: DataFrame, folder: str, cells: int = CELLS, parts: int = PARTS, words: int = WORDS, most_rows: int = MOST_ROWS, seed: int = SEED) -> None:
    """Fit the cells, then the code words, a part of the vectors a task, and store them under folder/model. words: 256 at most."""
    sample = stage(unit_vectors(vectors).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_rows), "index-sample")
    dim = sample.agg(F.max(F.size("u"))).first()[0]
    if dim is None or dim % parts:
        raise ValueError("no usable vector to train on" if dim is None else f"{dim} components can't be cut into {parts} parts")
    schema = "kind string, part int, number int, middle array<double>"

    def rows_of(kind: str, part: int, middle: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "part": part, "number": range(len(middle)), "middle": list(middle)})

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.stack(pd.concat(batches)["u"].to_numpy())
        yield rows_of("cell", -1, _lloyd(x, cells, 15, seed))

    same = sample.where(F.size("u") == dim)
    coarse_rows = stage(same.select("u").repartition(1).mapInPandas(coarse, schema), "index-cells")
    middle = np.array([r["middle"] for r in coarse_rows.orderBy("number").collect()])  # `cells` rows

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["u"].to_numpy())
            rest = x - middle[_nearest(x, middle)]
            for part, own in enumerate(np.split(rest, parts, axis=1)):
                yield pd.DataFrame({"part": part, "x": list(own)})

    def fine(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        return rows_of("word", part, _lloyd(np.stack(rows["x"].to_numpy()), words, 15, seed + part + 1))

    fine_rows = same.select("u").mapInPandas(left, "part int, x array<double>").groupBy("part").applyInPandas(fine, schema)
    coarse_rows.unionByName(fine_rows).write.mode("overwrite").parquet(f"{folder}/model")
    unstage(sample)
    unstage(coarse_rows)


def model_of(spark: SparkSession, folder: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centroids, code words by part): cells + parts * words rows."""
    rows = spark.read.parquet(f"{folder}/model").orderBy("kind", "part", "number").collect()
    parts = 1 + max(r["part"] for r in rows)
    return np.array([r["middle"] for r in rows if r["kind"] == "cell"]), [np.array([r["middle"] for r in rows if r["kind"] == "word" and r["part"] == p]) for p in range(parts)]


def add_vectors(spark: SparkSession, folder: str, vectors: DataFrame) -> None:
    """Code every usable vector of the model's length and append it to the index; repeated rows are entries of their own."""
    middle, words = model_of(spark, folder)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["u"].to_numpy()) if len(rows) else np.zeros((0, middle.shape[1]))
            cell = _nearest(x, middle)
            rest = np.split(x - middle[cell], len(words), axis=1)
            codes = np.stack([_nearest(r, w) for r, w in zip(rest, words, strict=True)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"vec_id": rows["vec_id"], "code": [c.tobytes() for c in codes], "u": rows["u"], "cell": cell})

    units = unit_vectors(vectors).where(F.size("u") == middle.shape[1])
    units.mapInPandas(code, f"vec_id {kind}, code binary, u array<double>, cell int").write.mode("append").partitionBy("cell").parquet(f"{folder}/entries")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int = CELLS // 2, refine: int = 20) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest by cosine of each query (vec_id, embedding), itself left out.

    Reads the `probes` nearest cells of each query, only folders of cells that a query probes. A query that is no usable vector has no
    row; of equal scores the lesser id comes first.
    """
    middle, words = model_of(spark, folder)
    parts = len(words)
    kind = queries.schema["vec_id"].dataType.simpleString()
    asked = stage(unit_vectors(queries).where(F.size("u") == middle.shape[1]).dropDuplicates(["vec_id"]), "index-queries")

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows["u"].to_numpy()) if len(rows) else np.zeros((0, middle.shape[1]))
            near = ((middle * middle).sum(axis=1) - 2 * x @ middle.T).argsort(axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"vec_id": rows["vec_id"].repeat(near.shape[1]), "u": rows["u"].repeat(near.shape[1]), "cell": near.ravel()})

    wanted = stage(asked.mapInPandas(probed, f"vec_id {kind}, u array<double>, cell int"), "index-probes")
    cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # `cells` rows at most
    entries = spark.read.parquet(f"{folder}/entries").where(F.col("cell").isin(cells))
    classes = stage(entries.select("cell", "code", "vec_id").distinct().groupBy("cell", "code").agg(F.count("*").alias("n")), "index-classes")
    keep = refine * k

    def compare(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """The best classes of a block for each query, until they hold `keep` rows."""
        at = np.zeros(0, np.int64)
        of, nears = at, np.zeros(0)
        if len(own) and len(met):
            code, n = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), parts), own["n"].to_numpy()
            x = np.stack(met["u"].to_numpy())
            score = np.repeat((x @ middle[int(key[0])])[:, None], len(own), axis=1)
            for part, (q, w) in enumerate(zip(np.split(x, parts, axis=1), words, strict=True)):
                score += (q @ w.T)[:, code[:, part]]
            orders = [best_first(near, n, keep) for near in score]
            at, of = np.concatenate(orders), np.repeat(np.arange(len(met)), [len(order) for order in orders])
            nears = score[of, at]
        return pd.DataFrame({"query_id": met["vec_id"].to_numpy()[of], "cell": int(key[0]), "code": own["code"].to_numpy()[at], "n": own["n"].to_numpy()[at], "near": nears})

    met = in_blocks(classes, wanted, ["cell"], ["cell", "code", "n"], ["vec_id", "u"])
    found = met.applyInPandas(compare, f"query_id {kind}, cell int, code binary, n long, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "cell", "code")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = stage(found.withColumn("_before", before).where(F.col("_before") < keep + 1).select("query_id", "cell", "code", "n"), "index-best")  # itself may be one

    told = best.join(asked.select(F.col("vec_id").alias("query_id"), F.col("u").alias("q")), "query_id")
    score = F.aggregate(F.zip_with("u", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    few = told.where(F.col("n") <= CROWDED).join(entries, ["cell", "code"]).select("query_id", "vec_id", F.round(score, 6).alias("score"))

    def rank(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """The k best rows of a block of a class for each query."""
        out: list = []
        if len(own) and len(met):
            ids, score = own["vec_id"].to_numpy(), np.round(np.stack(met["q"].to_numpy()) @ np.stack(own["u"].to_numpy()).T, 6)
            for q, near in zip(met["query_id"].to_numpy(), score, strict=True):
                order = np.lexsort((ids, -near))
                first = np.sort(np.unique(ids[order], return_index=True)[1])[: k + 1]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[order][first], "score": near[order][first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    crowded = best.where(F.col("n") > CROWDED).select("cell", "code").distinct()
    many = in_blocks(entries.join(crowded, ["cell", "code"], "left_semi"), told.where(F.col("n") > CROWDED), ["cell", "code"], ["vec_id", "u"], ["query_id", "q"]).applyInPandas(rank, f"query_id {kind}, vec_id {kind}, score double")
    scored = few.unionByName(many).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def best_first(near: np.ndarray, n: np.ndarray, keep: int) -> np.ndarray:
    """Places of the classes nearest first, of equal ones the first first, until those taken hold `keep` rows: only what may be among them is sorted."""
    may = np.arange(len(near))
    if len(near) > keep:
        may = np.flatnonzero(near >= np.partition(near, len(near) - keep)[len(near) - keep])
    order = may[np.argsort(-near[may], kind="stable")]
    return order[: int(np.searchsorted(np.cumsum(n[order]), keep)) + 1]


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], own: list[str], other: list[str]):
    """Rows of both sides with equal keys, cogrouped in blocks of CODE_BLOCK and QUERY_BLOCK rows: each pair of blocks is one group."""
    numbers = left.groupBy(*keys).agg(F.ceil(F.count("*") / CODE_BLOCK).cast("int").alias("_cn")).join(right.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_qn")), keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = left.join(numbers, keys).withColumn("_cb", F.pmod(F.xxhash64(*own), F.col("_cn")).cast("int")).withColumn("_qb", every("_qn"))
    theirs = right.join(numbers, keys).withColumn("_qb", F.pmod(F.xxhash64(*other), F.col("_qn")).cast("int")).withColumn("_cb", every("_cn"))
    groups = [*keys, "_cb", "_qb"]
    return mine.select(*groups, *[c for c in own if c not in keys]).groupBy(*groups).cogroup(theirs.select(*groups, *[c for c in other if c not in keys]).groupBy(*groups))


@query("t3b_stored_pq_search")
def t3b(spark, d):
    """An index trained on and filled with all vectors in two additions, then read from its folder for every query whose id is divisible by 100.

    These vectors hardly cluster, so most cells are probed.
    """
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    folder = landing(spark, "index")
    train_index(vectors, folder)
    for half in (0, 1):
        add_vectors(spark, folder, vectors.where(F.pmod("vec_id", F.lit(2)) == half))
    return search_index(spark, folder, vectors.where("vec_id % 100 = 0"), probes=13, refine=40)
