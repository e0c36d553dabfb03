"""Windows: versions, hash chains, budgets, islands, trends and nearest preceding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.runtime import table


@query("w1_version_chain", f"WITH {views.VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY effective, law, line) AS version FROM versions) SELECT section, law, line, version, version = max(CASE WHEN action <> 'repealed' THEN version END) OVER (PARTITION BY section) AS current FROM n")
def w1(spark, d):
    order = Window.partitionBy("section").orderBy("effective", "law", "line")
    rows = views.versions(spark, d).withColumn("version", F.row_number().over(order).cast("long"))
    last = F.max(F.when(F.col("action") != "repealed", F.col("version"))).over(Window.partitionBy("section"))
    return rows.select("section", "law", "line", "version", (F.col("version") == last).alias("current"))


@query("w2_chain_intervals", f"WITH {views.VERSIONS} SELECT section, law, line, row_number() OVER w = 1 AS first, lead(law) OVER w IS NULL AS last, CAST(effective - lag(effective) OVER w AS INTEGER) AS days FROM versions WINDOW w AS (PARTITION BY section ORDER BY effective, law, line)")
def w2(spark, d):
    w = Window.partitionBy("section").orderBy("effective", "law", "line")
    return views.versions(spark, d).select("section", "law", "line", (F.row_number().over(w) == 1).alias("first"), F.lead("law").over(w).isNull().alias("last"), F.datediff("effective", F.lag("effective").over(w)).alias("days"))


def verify_chain(blocks: DataFrame, ledger: str = "ledger") -> DataFrame:
    """W3, SRC35: each block's hash recomputed and compared with the next one's link; blocks of (ledger, seq, data, prev_hash, hash)."""
    before = F.lag("hash").over(Window.partitionBy(ledger).orderBy("seq"))
    good = (F.sha2(F.concat_ws("|", "seq", "data", "prev_hash"), 256) == F.col("hash")) & (F.coalesce(before, F.lit("0")) == F.col("prev_hash"))
    return blocks.select(ledger, "seq", good.alias("good"))


@query("w3_verify_hash_chain", f"WITH {views.LOG}, b AS (SELECT document AS ledger, row_number() OVER (PARTITION BY document ORDER BY ts, id) AS seq, CAST(k AS VARCHAR) AS data, '0' AS z FROM log), h AS (SELECT *, sha256(CAST(seq AS VARCHAR) || '|' || data || '|' || z) AS hash FROM b) SELECT ledger, seq, seq = 1 AS good FROM h")
def w3(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id")
    blocks = views.review_log(spark, d).select(F.col("document").alias("ledger"), F.row_number().over(w).cast("long").alias("seq"), F.col("k").cast("string").alias("data"), F.lit("0").alias("prev_hash"))
    return verify_chain(blocks.withColumn("hash", F.sha2(F.concat_ws("|", "seq", "data", "prev_hash"), 256)))


def token_budget(frame: DataFrame, by: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The first rows of each group while their tokens stay within the budget."""
    total = F.sum(tokens).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("_used", total).where(F.col("_used") <= budget).drop("_used")


@query("w4_token_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def w4(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("tokens"))
    return token_budget(rows, "conv_id", ["turn"], "tokens", 300).select("conv_id", "turn")


@query("w5_history_window", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER w AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 400 AND rn <= 4")
def w5(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("tokens"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("rn"))
    return token_budget(rows, "conv_id", [F.desc("turn")], "tokens", 400).where("rn <= 4").select("conv_id", "turn")


@query("w6_running_totals", f"WITH {views.CASES} SELECT case_id, sum(CAST(penalty * 100 AS BIGINT)) OVER (PARTITION BY party ORDER BY day, case_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cents FROM cases")
def w6(spark, d):
    w = Window.partitionBy("party").orderBy("day", "case_id").rowsBetween(Window.unboundedPreceding, 0)
    return views.cases(spark, d).select("case_id", F.sum(F.round(F.col("penalty") * 100).cast("long")).over(w).alias("cents"))


def trend(frame: DataFrame, by: str, order: list, value: str, edge: int = 3, band: float = 5.0) -> DataFrame:
    """Mean of the last rows against that of the first; within the band it is stable."""
    up, down = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    rows = frame.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down))
    ends = rows.groupBy(by).agg(F.avg(F.when(F.col("_z") <= edge, F.col(value))).alias("late"), F.avg(F.when(F.col("_a") <= edge, F.col(value))).alias("early"))
    gap = F.col("late") - F.col("early")
    return ends.select(by, F.round(gap, 4).alias("change"), F.when(gap > band, "rising").when(gap < -band, "falling").otherwise("stable").alias("trend"))


@query("w7_trend", f"WITH {views.LOG}, r AS (SELECT document, k, row_number() OVER (PARTITION BY document ORDER BY ts, id) AS a, row_number() OVER (PARTITION BY document ORDER BY ts DESC, id DESC) AS z FROM log), e AS (SELECT document, avg(k) FILTER (z <= 3) - avg(k) FILTER (a <= 3) AS gap FROM r GROUP BY document) SELECT document, round(gap, 4) AS change, CASE WHEN gap > 5 THEN 'rising' WHEN gap < -5 THEN 'falling' ELSE 'stable' END AS trend FROM e")
def w7(spark, d):
    return trend(views.review_log(spark, d), "document", ["ts", "id"], "k")


@query("w8_rank_of_results", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM lineitem WHERE l_tax > 0.02")
def w8(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber")
    return table(spark, d, "lineitem").where("l_tax > 0.02").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rank"))


def nearest_parent(frame: DataFrame, by: str, order: list, level: str, node: str, levels: int) -> DataFrame:
    """The nearest row before with a lower level; child.parent = parent. One sort, no self-join."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    seen = [F.last(F.when(F.col(level) == k, F.struct(F.col("_at"), F.col(node))), ignorenulls=True).over(w).alias(f"_l{k}") for k in range(levels)]
    rows = frame.withColumn("_at", place).select("*", *seen)
    parent = F.lit(None)
    for k in range(1, levels):
        best = F.greatest(*[F.col(f"_l{j}") for j in range(k)]) if k > 1 else F.col("_l0")
        parent = F.when(F.col(level) == k, best[node]).otherwise(parent)
    return rows.select(node, parent.alias("parent"))


@query("w9_section_hierarchy", f"WITH {views.LOG}, r AS (SELECT *, k % 4 AS level, row_number() OVER (PARTITION BY document ORDER BY ts, id) AS at FROM log) SELECT a.id, (SELECT arg_max(b.id, b.at) FROM r b WHERE b.document = a.document AND b.at < a.at AND b.level < a.level) AS parent FROM r a")
def w9(spark, d):
    rows = views.review_log(spark, d).withColumn("level", F.col("k") % 4)
    return nearest_parent(rows, "document", ["ts", "id"], "level", "id", 4)


def islands(changed: Column, window) -> Column:
    """A number that grows by one wherever a new island begins."""
    return F.sum(changed.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))


@query("w10_merge_small_chunks", "WITH t AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations) SELECT conv_id, CAST(coalesce(before, 0) // 1000 AS BIGINT) AS chunk, sum(n)::BIGINT AS n_chars, min(turn) AS first_turn FROM t GROUP BY 1, 2")
def w10(spark, d):
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.floor(before / 1000).alias("chunk"))
    return rows.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n_chars"), F.min("turn").alias("first_turn"))


@query("w11_merge_adjacent_same_type", f"WITH {views.LOG}, c AS (SELECT *, CASE WHEN type = lag(type) OVER w THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY document ORDER BY ts, id)), i AS (SELECT *, sum(new) OVER (PARTITION BY document ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT document, island::BIGINT AS island, any_value(type) AS type, count(*) AS n, min(id) AS first FROM i GROUP BY document, island")
def w11(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id")
    rows = views.review_log(spark, d).withColumn("new", ~F.col("type").eqNullSafe(F.lag("type").over(w)))
    return rows.withColumn("island", islands(F.col("new"), w)).groupBy("document", "island").agg(F.any_value("type").alias("type"), F.count("*").alias("n"), F.min("id").alias("first"))


@query("w12_longest_run", f"WITH {views.LOG}, c AS (SELECT document, k >= 40 AS hit, row_number() OVER (PARTITION BY document ORDER BY ts, id) - row_number() OVER (PARTITION BY document, k >= 40 ORDER BY ts, id) AS g FROM log), r AS (SELECT document, g, count(*) AS n FROM c WHERE hit GROUP BY 1, 2) SELECT document, max(n) AS longest FROM r GROUP BY document")
def w12(spark, d):
    w, v = Window.partitionBy("document").orderBy("ts", "id"), Window.partitionBy("document", "hit").orderBy("ts", "id")
    rows = views.review_log(spark, d).withColumn("hit", F.col("k") >= 40)
    rows = rows.withColumn("g", F.row_number().over(w) - F.row_number().over(v)).where("hit")
    return rows.groupBy("document", "g").agg(F.count("*").alias("n")).groupBy("document").agg(F.max("n").alias("longest"))


def gap_groups(frame: DataFrame, by: str, order: list, value: str, gap: float) -> DataFrame:
    """A new group where the value is over `gap` from the row before."""
    w = Window.partitionBy(by).orderBy(*order)
    return frame.withColumn("_new", F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) > gap, F.lit(True))).withColumn("band", islands(F.col("_new"), w)).drop("_new")


@query("w13_rows_by_tolerance", f"WITH {views.GEO}, g AS (SELECT *, CASE WHEN abs(lat - lag(lat) OVER (PARTITION BY source ORDER BY lat, id)) <= 0.05 THEN 0 ELSE 1 END AS new FROM geo), b AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY lat, id ROWS UNBOUNDED PRECEDING) AS band FROM g) SELECT source, band::BIGINT AS band, count(*) AS n, min(lat) AS top FROM b GROUP BY 1, 2")
def w13(spark, d):
    return gap_groups(views.geo_events(spark, d), "source", ["lat", "id"], "lat", 0.05).groupBy("source", "band").agg(F.count("*").alias("n"), F.min("lat").alias("top"))


@query("w14_blocks_by_gap", f"WITH {views.LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR AND abs(gap - lag(gap) OVER w) < 50 THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY document ORDER BY ts, id)), b AS (SELECT *, sum(new) OVER (PARTITION BY document ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS block FROM g) SELECT document, block::BIGINT AS block, count(*) AS n FROM b GROUP BY 1, 2")
def w14(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id")
    joined = (F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 6 HOURS")) & (F.abs(F.col("gap") - F.lag("gap").over(w)) < 50)
    rows = views.review_log(spark, d).withColumn("new", ~F.coalesce(joined, F.lit(False)))
    return rows.withColumn("block", islands(F.col("new"), w)).groupBy("document", "block").agg(F.count("*").alias("n"))


@query("w15_largest_gaps", f"WITH {views.GEO}, g AS (SELECT source, lon - lag(lon) OVER w AS gap, (lon + lag(lon) OVER w) / 2 AS middle, id FROM geo WINDOW w AS (PARTITION BY source ORDER BY lon, id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap DESC, id) AS rn FROM g WHERE gap > 0.05) SELECT source, round(middle, 6) AS middle, round(gap, 6) AS gap FROM r WHERE rn <= 2")
def w15(spark, d):
    w = Window.partitionBy("source").orderBy("lon", "id")
    rows = views.geo_events(spark, d).select("source", "id", (F.col("lon") - F.lag("lon").over(w)).alias("gap"), ((F.col("lon") + F.lag("lon").over(w)) / 2).alias("middle")).where("gap > 0.05")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("gap"), "id"))).where("rn <= 2").select("source", F.round("middle", 6).alias("middle"), F.round("gap", 6).alias("gap"))


@query("w16_running_mean_min_max", f"WITH {views.LOG} SELECT id, round(avg(k) OVER w, 6) AS mean, min(k) OVER w AS low, max(k) OVER w AS high FROM log WINDOW w AS (PARTITION BY document ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def w16(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return views.review_log(spark, d).select("id", F.round(F.avg("k").over(w), 6).alias("mean"), F.min("k").over(w).alias("low"), F.max("k").over(w).alias("high"))


@query("w17_latest_record", f"WITH {views.LOG} SELECT document, arg_max(id, (ts, id)) AS id, arg_max(status, (ts, id)) AS status FROM log GROUP BY document")
def w17(spark, d):
    return views.review_log(spark, d).groupBy("document").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max_by("status", F.struct("ts", "id")).alias("status"))


@query("w18_adjacent_comparison", "SELECT conv_id, turn, role = lag(role) OVER w AS same_role, length(text) - lag(length(text)) OVER w AS growth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w18(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == F.lag("role").over(w)).alias("same_role"), (n - F.lag(n).over(w)).alias("growth"))


@query("w19_lines_of_words", f"WITH {views.GEO}, g AS (SELECT *, CASE WHEN lat - lag(lat) OVER (PARTITION BY type ORDER BY lat, lon, id) <= 0.001 THEN 0 ELSE 1 END AS new FROM geo), b AS (SELECT *, sum(new) OVER (PARTITION BY type ORDER BY lat, lon, id ROWS UNBOUNDED PRECEDING) AS line FROM g) SELECT type, line::BIGINT AS line, min(lon) AS x0, max(lon) AS x1, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY lon, id) AS words FROM b GROUP BY 1, 2")
def w19(spark, d):
    rows = gap_groups(views.geo_events(spark, d), "type", ["lat", "lon", "id"], "lat", 0.001).withColumnRenamed("band", "line")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lon", "id"))), lambda x: x["id"].cast("string")), " ")
    return rows.groupBy("type", "line").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), words.alias("words"))


@query("w20_collapse_list_items", f"WITH {views.LOG}, c AS (SELECT *, CASE WHEN expert AND lag(expert) OVER w THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY document ORDER BY ts, id)), i AS (SELECT *, sum(new) OVER (PARTITION BY document ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS element FROM c) SELECT document, element::BIGINT AS element, bool_and(expert) AS is_list, count(*) AS n, min(gap) AS low, max(gap) AS high FROM i GROUP BY 1, 2")
def w20(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id")
    rows = views.review_log(spark, d).withColumn("new", ~(F.col("expert") & F.coalesce(F.lag("expert").over(w), F.lit(False))))
    return rows.withColumn("element", islands(F.col("new"), w)).groupBy("document", "element").agg(F.bool_and("expert").alias("is_list"), F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
