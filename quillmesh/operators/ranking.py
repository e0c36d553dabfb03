"""Vector search, ranking, fusion, set operations and deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.filters import first_pool
from quillmesh.runtime import stage, table


def dot(vector: list[float]) -> Column:
    """FN16: the dot product of `embedding` with a literal vector, in double precision."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    return F.aggregate(F.zip_with(F.col("embedding"), literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, vector: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """The k nearest by cosine of unit vectors. The filter comes first, so no over-fetching is needed."""
    rows = vectors.where(keep) if keep is not None else vectors
    return rows.withColumn("score", F.round(dot(vector), 6)).orderBy(F.desc("score"), "vec_id").limit(k)


def query_vector(spark, d, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"


@query("t1_knn_topk", f"WITH {_Q} SELECT vec_id, label, score FROM s WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 10")
def t1(spark, d):
    return knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, F.col("label") != 3).select("vec_id", "label", "score")


@query("t2_knn_distinct_rank", f"WITH {_Q}, b AS (SELECT label, max(score) AS score, arg_max(vec_id, (score, -vec_id)) AS vec_id FROM s GROUP BY label) SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM b ORDER BY rank LIMIT 5")
def t2(spark, d):
    scored = table(spark, d, "embeddings").withColumn("score", F.round(dot(query_vector(spark, d)), 6))
    best = scored.groupBy("label").agg(F.max("score").alias("score"), F.max_by("vec_id", F.struct("score", (-F.col("vec_id")).alias("o"))).alias("vec_id"))
    top = best.orderBy(F.desc("score"), "vec_id").limit(5)
    return top.select("vec_id", "label", "score", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"))  # five rows


def ivf_search(vectors: DataFrame, queries: DataFrame, centres: int, probes: int, k: int, seed: int = 7) -> DataFrame:
    """An inverted file: KMeans cells, the `probes` nearest cells of each query, exact scores inside, block by block of a cell's rows and queries."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from quillmesh.operators.vector_index import in_blocks  # it imports a module that imports this one

    frame = vectors.select("vec_id", "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=centres, seed=seed, maxIter=10).fit(frame)
    middle = np.array(model.clusterCenters())  # `centres` rows, a parameter

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(column: pd.Series) -> pd.Series:
        x = np.stack(column.to_numpy()).astype(np.float64)
        distance = ((middle * middle).sum(axis=1) - 2 * x @ middle.T).argsort(axis=1, kind="stable")
        return pd.Series(list(distance[:, :probes].astype(np.int32)))

    cells = stage(model.transform(frame).select("vec_id", "embedding", F.col("prediction").alias("cell")), "file-cells")
    probed = stage(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(nearest("embedding")).alias("cell")), "file-probes")
    kind, asked = (f.schema["vec_id"].dataType.simpleString() for f in (vectors, queries))

    def compare(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        """Of a block of a cell the rows that may be among the k best of each query of a block: products are added up place by place, as in a fold."""
        out: list = []
        if len(own) and len(met):
            ids, x, q = own["vec_id"].to_numpy(), np.stack(own["embedding"].to_numpy()).astype(np.float64), np.stack(met["q"].to_numpy()).astype(np.float64)
            score = np.zeros((len(q), len(x)))
            for a, b in zip(q.T, x.T, strict=True):
                score += a[:, None] * b[None, :]
            for query_id, near in zip(met["query_id"].to_numpy(), score, strict=True):
                most = min(k + 1, len(near))  # itself may be one
                at = np.flatnonzero(near >= np.partition(near, -most)[-most] - 1e-6)  # those that rounding may put on a par
                at = at[np.lexsort((ids[at], -near[at]))]
                first = np.flatnonzero(np.r_[True, near[at][1:] != near[at][:-1]])
                at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) <= k]  # of equal scores the least ids
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at], "score": near[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    blocks = in_blocks(cells, probed, ["cell"], ["vec_id", "embedding"], ["query_id", "q"])
    found = blocks.applyInPandas(compare, f"query_id {asked}, vec_id {kind}, score double").where("vec_id != query_id")
    pairs = found.select("query_id", "vec_id", F.round("score", 6).alias("score"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


@query("t3_ivf_search")
def t3(spark, d):
    vectors = table(spark, d, "embeddings")
    return ivf_search(vectors, vectors.where("vec_id % 100 = 0"), 16, 8, 5)


@query("t4_specialised_index", f"WITH {_Q} SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 3")
def t4(spark, d):
    scored = table(spark, d, "embeddings").withColumn("score", F.round(dot(query_vector(spark, d)), 6))
    return topk_per_group(scored, ["label"], [F.desc("score"), F.col("vec_id")], 3).select("label", "vec_id", "score")


def topk_per_group(frame: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the exchange."""
    return frame.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


@query("t5_vector_search_with_metadata", f"WITH {_Q} SELECT s.vec_id, coalesce(d.source, 'unknown') AS source, score FROM s LEFT JOIN documents d ON d.doc_id = s.vec_id AND d.lang = 'en' ORDER BY score DESC, s.vec_id LIMIT 8")
def t5(spark, d):
    top = knn(table(spark, d, "embeddings"), query_vector(spark, d), 8)
    docs = table(spark, d, "documents", "doc_id", "lang", "source").where("lang = 'en'")
    return top.join(docs, F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", F.coalesce("source", F.lit("unknown")).alias("source"), "score")


def hybrid(rows: DataFrame, v: str, g: str, both: str, k: int, reserved: int = 2) -> DataFrame:
    """0.6 vector, 0.3 graph, 0.1 for both; the top k keep `reserved` places for rows of the graph."""
    scored = rows.withColumn("score", F.round(0.6 * F.col(v) + 0.3 * F.col(g) + F.when(F.col(both), 0.1).otherwise(0.0), 6))
    top = scored.orderBy(F.desc("score"), "vec_id").limit(k).withColumn("_pool", F.lit(0))
    graph = scored.where(F.col(g) > 0).orderBy(F.desc("score"), "vec_id").limit(reserved).withColumn("_pool", F.lit(1))
    ranked = graph.unionByName(top).groupBy("vec_id").agg(F.max("score").alias("score"), F.max("_pool").alias("from_graph"))
    return ranked.orderBy(F.desc("from_graph"), F.desc("score"), "vec_id").limit(k).select("vec_id", "score", (F.col("from_graph") == 1).alias("reserved"))


@query("t6_hybrid_search", f"WITH {_Q}, h AS (SELECT vec_id, round(0.6 * score + 0.3 * CASE WHEN label = 5 THEN 0.5 ELSE 0 END + CASE WHEN label = 5 AND score > 0 THEN 0.1 ELSE 0 END, 6) AS score, label = 5 AS g FROM s), t AS (SELECT vec_id, score, 0 AS p FROM h ORDER BY score DESC, vec_id LIMIT 10), r AS (SELECT vec_id, score, 1 AS p FROM h WHERE g ORDER BY score DESC, vec_id LIMIT 2), u AS (SELECT vec_id, max(score) AS score, max(p) AS p FROM (SELECT * FROM t UNION ALL SELECT * FROM r) GROUP BY vec_id) SELECT vec_id, score, p = 1 AS reserved FROM u ORDER BY p DESC, score DESC, vec_id LIMIT 10")
def t6(spark, d):
    rows = table(spark, d, "embeddings").withColumn("v", F.round(dot(query_vector(spark, d)), 6)).withColumn("g", F.when(F.col("label") == 5, 0.5).otherwise(0.0))
    return hybrid(rows.withColumn("both", (F.col("g") > 0) & (F.col("v") > 0)), "v", "g", "both", 10)


@query("t7_context_rerank", f"WITH {_Q} SELECT vec_id, round(0.7 * score + 0.3 * (CASE WHEN label IN (1, 2) THEN 0.3 ELSE 0 END + 0.2 * (label % 3)), 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def t7(spark, d):
    context = F.when(F.col("label").isin(1, 2), 0.3).otherwise(0.0) + 0.2 * (F.col("label") % 3)
    rows = table(spark, d, "embeddings").select("vec_id", F.round(0.7 * F.round(dot(query_vector(spark, d)), 6) + 0.3 * context, 6).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10)


@query("t8_multiplicative_boost", f"WITH {_Q} SELECT vec_id, round(score * CASE WHEN label = 4 THEN 1.3 WHEN label = 7 THEN 1.2 ELSE 1.0 END, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def t8(spark, d):
    boost = F.when(F.col("label") == 4, 1.3).when(F.col("label") == 7, 1.2).otherwise(1.0)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.round(dot(query_vector(spark, d)), 6) * boost, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("t9_weighted_fusion", f"WITH {_Q} SELECT vec_id, round(CASE WHEN label < 5 THEN 0.7 * score + 0.3 * label / 10 ELSE 0.3 * score + 0.7 * label / 10 END, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 10")
def t9(spark, d):
    v, g = F.round(dot(query_vector(spark, d)), 6), F.col("label") / 10
    return table(spark, d, "embeddings").select("vec_id", F.round(F.when(F.col("label") < 5, 0.7 * v + 0.3 * g).otherwise(0.3 * v + 0.7 * g), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("t10_feature_ranking", "WITH s AS (SELECT doc_id, n_chars // 4 AS tokens, (CASE WHEN contains(text, 'tion') THEN 3 ELSE 0 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + least(n_chars // 500, 5))::BIGINT AS score FROM documents), t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 10), b AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT doc_id, score FROM b WHERE used <= 8000")
def t10(spark, d):
    score = F.when(F.contains("text", F.lit("tion")), 3).otherwise(0) + F.when(F.col("lang") == "en", 2).otherwise(0) + F.least(F.floor(F.col("n_chars") / 500), F.lit(5))
    top = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"), score.cast("long").alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)
    used = F.sum("tokens").over(Window.orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # ten rows
    return top.withColumn("used", used).where("used <= 8000").select("doc_id", "score")


@query("t11_prioritised_pools", "WITH p AS (SELECT source, doc_id, CASE WHEN lang = 'es' AND n_chars > 9000 THEN 1 WHEN lang = 'es' THEN 2 ELSE 3 END AS pr FROM documents), b AS (SELECT source, min(pr) AS pr FROM p GROUP BY source), r AS (SELECT p.*, row_number() OVER (PARTITION BY p.source ORDER BY doc_id) AS rn FROM p JOIN b ON b.source = p.source AND b.pr = p.pr) SELECT source, doc_id FROM r WHERE rn <= CASE WHEN pr < 3 THEN 8 ELSE 3 END")
def t11(spark, d):
    pool = F.when((F.col("lang") == "es") & (F.col("n_chars") > 9000), 1).when(F.col("lang") == "es", 2).otherwise(3)
    rows = first_pool(table(spark, d, "documents", "doc_id", "source", "lang", "n_chars").withColumn("pool", pool), F.col("pool"), ["source"])
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return rows.where(F.col("rn") <= F.when(F.col("pool") < 3, 8).otherwise(3)).select("source", "doc_id")


@query("t12_keyword_score", "SELECT doc_id, (len(regexp_extract_all(lower(text), 'tion')) + 2 * len(regexp_extract_all(lower(text), 'and')))::BIGINT AS score FROM documents WHERE len(regexp_extract_all(lower(text), 'tion')) + 2 * len(regexp_extract_all(lower(text), 'and')) > 0")
def t12(spark, d):
    score = F.regexp_count(F.lower("text"), F.lit("tion")) + 2 * F.regexp_count(F.lower("text"), F.lit("and"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", score.cast("long").alias("score")).where("score > 0")


@query("t13_links_per_node", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5")
def t13(spark, d):
    return topk_per_group(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_discount"), "l_orderkey", "l_linenumber"], 5).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("t14_pending_by_severity", f"WITH {views.LOG} SELECT id, severity, gap FROM log WHERE status = 'pending' ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, gap DESC, id LIMIT 100")
def t14(spark, d):
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return views.review_log(spark, d).where("status = 'pending'").orderBy(rank, F.desc("gap"), "id").limit(100).select("id", "severity", "gap")


@query("t15_action_items", f"WITH {views.LOG} SELECT module, count(*) AS n_pending, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (expert) AS n_expert FROM log WHERE status = 'pending' GROUP BY module HAVING count(*) > 5 ORDER BY n_pending DESC, module LIMIT 3")
def t15(spark, d):
    rows = views.review_log(spark, d).where("status = 'pending'").groupBy("module").agg(F.count("*").alias("n_pending"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if("expert").alias("n_expert"))
    return rows.where("n_pending > 5").orderBy(F.desc("n_pending"), "module").limit(3)


@query("t16_patrol_schedule", f"WITH {views.GEO}, r AS (SELECT CAST(floor(lat * 2) AS BIGINT) AS zone, round(avg(k), 4) AS risk FROM geo GROUP BY 1) SELECT zone, risk, CASE WHEN risk >= 50 THEN 'high' WHEN risk >= 49 THEN 'medium' ELSE 'low' END AS priority FROM r UNION ALL SELECT -1, 100.0, 'override' WHERE (SELECT max(risk) FROM r) > 49")
def t16(spark, d):
    r = views.geo_events(spark, d).groupBy(F.floor(F.col("lat") * 2).alias("zone")).agg(F.round(F.avg("k"), 4).alias("risk"))
    rows = r.select("zone", "risk", F.when(F.col("risk") >= 50, "high").when(F.col("risk") >= 49, "medium").otherwise("low").alias("priority"))
    override = r.agg(F.max("risk").alias("m")).where("m > 49").select(F.lit(-1).cast("long").alias("zone"), F.lit(100.0).alias("risk"), F.lit("override").alias("priority"))
    return rows.unionByName(override)


@query("t17_primary_response", f"WITH {views.LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY expert, k DESC, id) AS rn FROM log) SELECT document, id, k FROM r WHERE rn = 1 AND NOT expert")
def t17(spark, d):
    return topk_per_group(views.review_log(spark, d), ["document"], ["expert", F.desc("k"), "id"], 1).where("NOT expert").select("document", "id", "k")


@query("t18_spot_check", f"WITH {_Q} SELECT vec_id, score FROM s WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 3")
def t18(spark, d):
    return knn(table(spark, d, "embeddings"), query_vector(spark, d), 3, F.col("vec_id") != 0).select("vec_id", "score")


@query("t19_episodic_recall", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion') ORDER BY conv_id DESC, turn DESC LIMIT 10")
def t19(spark, d):
    return table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("tion"))).orderBy(F.desc("conv_id"), F.desc("turn")).limit(10).select("conv_id", "turn")


# ---------------------------------------------------------------- sets and deduplication


@query("s1_union_reindexed", "WITH u AS (SELECT vec_id, label, 0 AS part FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, label, 1 FROM embeddings WHERE label >= 5) SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS row_id, vec_id FROM u")
def s1(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    return renumbered([e.where("label < 5"), e.where("label >= 5")], "vec_id").select("row_id", "vec_id")


def renumbered(frames: list[DataFrame], key: str) -> DataFrame:
    """S1, SRC15: frames one after another, rows numbered from 0 in order of key; numbers are offsets of hash-free ranges.

    Counts of key ranges give each range's first number, so no task sees all rows.
    """
    rows = None
    for k, frame in enumerate(frames):
        one = frame.withColumn("_part", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    span = rows.groupBy("_part").agg(F.min(key).alias("_low"), (F.max(key) - F.min(key) + 1).alias("_width"))
    cells = rows.join(F.broadcast(span), "_part").withColumn("_cell", F.floor((F.col(key) - F.col("_low")) * 1024 / F.col("_width")))  # a row a frame
    before = Window.orderBy("_part", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.groupBy("_part", "_cell").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # 1024 rows a frame
    own = F.row_number().over(Window.partitionBy("_part", "_cell").orderBy(key)) - 1
    return cells.withColumn("_own", own).join(F.broadcast(firsts.drop("_n")), ["_part", "_cell"]).withColumn("row_id", F.col("_first") + F.col("_own")).drop("_part", "_cell", "_own", "_first", "_low", "_width")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """S2, SRC4, SRC18: rows of `old` that `new` doesn't have, and all of `new`, the last of a key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


@query("s2_upsert", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0")
def s2(spark, d):
    old = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("s3_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def s3(spark, d):
    return table(spark, d, "documents", "doc_id").intersect(table(spark, d, "labels", "doc_id"))


@query("s5_keep_first", "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def s5(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("l_linenumber"))


@query("s8_union_of_passes", "WITH p AS (SELECT l_orderkey AS chunk, 1 AS pass FROM lineitem WHERE l_partkey % 50 = 0 UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_suppkey % 10 = 0) SELECT chunk, count(*) AS hits, CAST(min(pass) AS INTEGER) AS first_pass FROM p GROUP BY chunk")
def s8(spark, d):
    items = table(spark, d, "lineitem")
    p = items.where("l_partkey % 50 = 0").select(F.col("l_orderkey").alias("chunk"), F.lit(1).alias("pass")).unionByName(items.where("l_suppkey % 10 = 0").select(F.col("l_orderkey").alias("chunk"), F.lit(2).alias("pass")))
    return p.groupBy("chunk").agg(F.count("*").alias("hits"), F.min("pass").alias("first_pass"))


@query("s9_concatenate_keep_first", "WITH u AS (SELECT o_custkey AS id, 0 AS src, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT id, arg_min(v, (src, v)) AS v FROM u GROUP BY id")
def s9(spark, d):
    part = lambda status, k: table(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"), F.lit(k).alias("src"), F.col("o_orderkey").alias("v"))
    return part("F", 0).unionByName(part("O", 1)).groupBy("id").agg(F.min_by("v", F.struct("src", "v")).alias("v"))


@query("s10_variants", "SELECT p_partkey, list_sort(list_distinct([p_name, replace(p_name, ' ', '_'), lower(p_brand)])) AS variants FROM part")
def s10(spark, d):
    # The order of a set of variants carries no meaning.
    variants = F.array_sort(F.array_distinct(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.lower("p_brand"))))
    return table(spark, d, "part").select("p_partkey", variants.alias("variants"))


@query("s11_skip_repeats", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def s11(spark, d):
    return table(spark, d, "orders").dropDuplicates(["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority")


@query("a33_earlier_duplicate_vectors", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT count(*) AS n_duplicates FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.vec_id < a.vec_id AND list_dot_product(a.v, b.v) >= 0.99)")
def a33(spark, d):
    """Rows with an earlier row at 0.99: the order-free count."""
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    return later_duplicates(vectors, 0.99).agg(F.count("*").alias("n_duplicates"))


#: Vectors that a task holds of either side.
BLOCK_ROWS = 16_000


def later_duplicates(vectors: DataFrame, least: float) -> DataFrame:
    """(vec_id) of vectors whose dot product with one of a smaller id is `least` or more; of vectors of one length and without nulls.

    All pairs are compared, in blocks: quadratic in time, with two blocks in a task. Single precision tells all but those within its error
    of `least`, which double precision does. Rows are told, not pairs, so copies cost no more.
    """
    rows = vectors.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS), 7)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("vec_id", "x", "own", F.size("x").alias("size"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def later(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = frame["vec_id"].to_numpy(), np.stack(frame["x"].to_numpy())
        mine = (frame["own"] == frame["i"]).to_numpy()
        single = frame["i"].iloc[0] == frame["j"].iloc[0]
        far = 1e-5 * max(1.0, float((x * x).sum(axis=1).max()))
        told = np.zeros(len(ids), bool)
        narrow = x.astype(np.float32)
        right = np.flatnonzero(mine if single else ~mine)
        for at in np.array_split(left := np.flatnonzero(mine), max(1, len(left) // 500)):
            score = narrow[at] @ narrow[right].T
            before = ids[at][:, None] < ids[right][None, :]
            after = ids[at][:, None] > ids[right][None, :]
            sure = score >= least + far
            told[right] |= (sure & before).any(axis=0)
            told[at] |= (sure & after).any(axis=1)
            for k, m in np.argwhere(~sure & (score > least - far)):
                if ids[at[k]] != ids[right[m]] and x[at[k]] @ x[right[m]] >= least:
                    told[max(at[k], right[m], key=lambda r: ids[r])] = True
        return pd.DataFrame({"vec_id": ids[told]})

    found = dealt.repartition(blocks * (blocks + 1) // 2, "size", "i", "j").groupBy("size", "i", "j").applyInPandas(later, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}")  # two blocks
    return found.distinct()


def near_pairs(vectors: DataFrame, cosine: float) -> DataFrame:
    """(a, b): vectors at a cosine of at least `cosine`, found by cells of the three coordinates' bands (exact).

    |x - y| of unit vectors at this cosine is at most r, so each coordinate differs by r at most; cells of
    width r on three coordinates and their neighbours hold every pair.
    """
    r = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    cell = [F.floor(F.element_at("embedding", k).cast("double") / r) for k in (1, 2, 3)]
    left = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u"), *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{k}") for k, s in enumerate((x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    right = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"), *[c.alias(f"d{k}") for k, c in enumerate(cell)], F.explode(steps).alias("s"))
    right = right.select("b", "w", *[(F.col(f"d{k}") + F.col(f"s.s{k}")).alias(f"c{k}") for k in range(3)])
    score = F.aggregate(F.zip_with("u", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return left.join(right, ["c0", "c1", "c2"]).where("a < b").where(score >= cosine).select("a", "b")
