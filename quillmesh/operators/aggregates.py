"""Aggregations: reports, distributions, merges by key, quality and risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.filters import recent
from quillmesh.runtime import numbered, stage, table

RESOLVED = ("auto_resolved", "manual_resolved", "system_fixed")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null where the whole is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def mean(column, digits: int = 4) -> Column:
    return F.round(F.avg(column), digits)


def count_if(test: Column) -> Column:
    return F.count_if(test)


def summary(frame: DataFrame, *by: str) -> DataFrame:
    """A1, A2: rows, critical rows, pending rows and the mean gap, by any columns."""
    return frame.groupBy(*by).agg(
        F.count("*").alias("n"), count_if(F.col("severity") == "critical").alias("n_critical"),
        count_if(F.col("status") == "pending").alias("n_pending"), mean("gap").alias("mean_gap"),
    )


_SUMMARY = "count(*) AS n, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (status = 'pending') AS n_pending, round(avg(gap), 4) AS mean_gap FROM log GROUP BY"


@query("a1_daily_summary", f"WITH {views.LOG} SELECT day, {_SUMMARY} day")
def a1(spark, d):
    return summary(views.review_log(spark, d), "day")


@query("a2_module_performance", f"WITH {views.LOG} SELECT module, {_SUMMARY} module")
def a2(spark, d):
    return summary(views.review_log(spark, d), "module")


@query("a3_expert_issues", f"WITH {views.LOG} SELECT stage, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types, round(avg(gap), 4) AS mean_gap FROM log WHERE expert GROUP BY stage")
def a3(spark, d):
    return views.review_log(spark, d).where("expert").groupBy("stage").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("type"))).alias("types"), mean("gap").alias("mean_gap"))


def top_shares(frame: DataFrame, by: str, n: int) -> DataFrame:
    """A4: the n most common values and their share of all rows."""
    total = frame.agg(F.count("*").alias("total"))
    counts = frame.groupBy(F.col(by).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n).crossJoin(F.broadcast(total)).select("value", "n", share(F.col("n"), F.col("total")).alias("share"))


@query("a4_statistics_top_documents", f"WITH {views.LOG} SELECT CAST(document AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM log), 4) AS share FROM log GROUP BY document ORDER BY n DESC, value LIMIT 5")
def a4(spark, d):
    return top_shares(views.review_log(spark, d), "document", 5)


@query("a5_running_counters", f"WITH {views.LOG} SELECT 'type' AS dimension, type AS value, count(*) AS n FROM log GROUP BY type UNION ALL SELECT 'severity', severity, count(*) FROM log GROUP BY severity UNION ALL SELECT 'stage', stage, count(*) FROM log GROUP BY stage UNION ALL SELECT 'status', status, count(*) FROM log GROUP BY status UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FROM log GROUP BY hour(ts)")
def a5(spark, d):
    return distributions(views.review_log(spark, d).withColumn("hour", F.hour("ts").cast("string")), ["type", "severity", "stage", "status", "hour"])


def distributions(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns, in one pass over grouping sets of one column each."""
    grouped = frame.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    bits = {c: ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - k)) for k, c in enumerate(columns)}
    name = value = None
    for c in columns:
        hit = F.col("gid") == bits[c]
        name = F.when(hit, c) if name is None else name.when(hit, c)
        value = F.when(hit, F.col(c).cast("string")) if value is None else value.when(hit, F.col(c).cast("string"))
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


@query("a6_period_report", f"WITH {views.LOG}, w AS (SELECT * FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY), c AS (SELECT type, count(*) AS n FROM w GROUP BY type) SELECT count(*) AS n, round(avg(gap), 4) AS mean_gap, max(gap) AS max_gap, count(DISTINCT document) AS documents, (SELECT type FROM c ORDER BY n DESC, type LIMIT 1) AS main_type, round(100.0 * count(*) FILTER (status IN ('auto_resolved', 'manual_resolved', 'system_fixed')) / count(*), 2) AS resolved_pct FROM w")
def a6(spark, d):
    rows = recent(views.review_log(spark, d), "ts", 7)
    main = rows.groupBy("type").agg(F.count("*").alias("n")).agg(F.max_by("type", F.struct(F.col("n"), -F.ascii("type"))).alias("main_type"))
    report = rows.agg(F.count("*").alias("n"), mean("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.count_distinct("document").alias("documents"), F.round(100.0 * count_if(F.col("status").isin(*RESOLVED)) / F.count("*"), 2).alias("resolved_pct"))
    return report.crossJoin(F.broadcast(main))


def merge_longest(frame: DataFrame, key: list[str], properties: list[str], order: str) -> DataFrame:
    """One row a key; each property keeps its longest text, the first of equal ones."""
    best = [F.max_by(c, F.when(F.col(c) != "", F.struct(F.length(c).alias("n"), (-F.col(order)).alias("o")))).alias(c) for c in properties]
    return frame.groupBy(*key).agg(*best, F.count("*").alias("n_merged"))


@query("a7_merge_nodes_longest_value", "WITH r AS (SELECT p_brand AS node, p_name AS name, p_type AS kind, p_partkey AS o FROM part) SELECT node, arg_max(name, (length(name), -o)) AS name, arg_max(kind, (length(kind), -o)) AS kind, count(*) AS n_merged FROM r GROUP BY node")
def a7(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("node"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("o"))
    return merge_longest(rows, ["node"], ["name", "kind"], "o")


@query("a8_merge_edges_longest_value", "WITH r AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_returnflag AS type, CAST(l_extendedprice AS VARCHAR) AS note, l_orderkey * 10 + l_linenumber AS o FROM (SELECT l_suppkey, l_partkey, l_returnflag, CAST(l_extendedprice AS BIGINT) AS l_extendedprice, l_orderkey, l_linenumber FROM lineitem)) SELECT src, dst, type, length(arg_max(note, (length(note), -o))) AS longest, count(*) AS n_merged FROM r GROUP BY src, dst, type")
def a8(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag").alias("type"), F.round("l_extendedprice").cast("long").cast("string").alias("note"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return merge_longest(rows, ["src", "dst", "type"], ["note"], "o").select("src", "dst", "type", F.length("note").cast("long").alias("longest"), "n_merged")


@query("a9_duplicate_keeper", "SELECT p_name, p_partkey AS keeper FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE rn = 1 AND n > 1")
def a9(spark, d):
    best = F.struct("p_size", "p_retailprice", (-F.col("p_partkey")).alias("o"))
    return table(spark, d, "part").groupBy("p_name").agg(F.max_by("p_partkey", best).alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("a10_case_statistics", f"WITH {views.CASES} SELECT category, count(*) AS n, round(100.0 * count(*) FILTER (verdict = 'guilty') / count(*), 2) AS conviction_pct, round(avg(penalty), 2) AS mean_penalty, max(penalty) AS max_penalty, round(count(*) FILTER (night) / count(*), 4) AS night_share FROM cases GROUP BY category")
def a10(spark, d):
    return views.cases(spark, d).groupBy("category").agg(
        F.count("*").alias("n"), F.round(100.0 * count_if(F.col("verdict") == "guilty") / F.count("*"), 2).alias("conviction_pct"),
        mean("penalty", 2).alias("mean_penalty"), F.max("penalty").alias("max_penalty"), share(count_if(F.col("night")), F.count("*")).alias("night_share"),
    )


@query("a11_penalty_percentiles", f"WITH {views.CASES} SELECT category, CAST(floor(quantile_cont(penalty, 0.25)) AS BIGINT) AS low, CAST(floor(quantile_cont(penalty, 0.5)) AS BIGINT) AS middle, CAST(floor(quantile_cont(penalty, 0.75)) AS BIGINT) AS high, count(*) AS n FROM cases GROUP BY category")
def a11(spark, d):
    q = F.percentile("penalty", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = views.cases(spark, d).groupBy("category").agg(q.alias("q"), F.count("*").alias("n"))
    return rows.select("category", *[F.floor(F.col("q")[k]).alias(c) for k, c in enumerate(("low", "middle", "high"))], "n")


def outcome_prediction(frame: DataFrame, by: list[str]) -> DataFrame:
    """Rate, range and spread of outcomes; confidence falls with the coefficient of variation, grows by 0.04 a case, 0.98 at most."""
    fines = F.when(F.col("penalty") > 0, F.col("penalty"))
    rows = frame.groupBy(*by).agg(
        F.count("*").alias("n"), share(count_if(F.col("verdict") == "guilty"), F.count("*")).alias("guilty_rate"),
        F.min(fines).alias("low"), F.max(fines).alias("high"), F.avg(fines).alias("m"), F.stddev_samp(fines).alias("sd"),
    )
    base = F.when(F.col("sd").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.nullif("m", F.lit(0.0))))
    return rows.select(*by, "n", "guilty_rate", "low", "high", F.round("m", 6).alias("mean_fine"), F.round(F.least(F.lit(0.98), base + F.col("n") * 0.04), 4).alias("confidence"))


@query("a12_judgment_prediction", f"WITH {views.CASES}, a AS (SELECT party, count(*) AS n, round(count(*) FILTER (verdict = 'guilty') / count(*), 4) AS guilty_rate, min(penalty) AS low, max(penalty) AS high, avg(penalty) AS m, stddev_samp(penalty) AS sd FROM cases WHERE penalty > 0 GROUP BY party) SELECT party, n, guilty_rate, low, high, round(m, 6) AS mean_fine, round(least(0.98, CASE WHEN sd IS NULL THEN 0.5 ELSE greatest(0.0, 1 - sd / m) END + n * 0.04), 4) AS confidence FROM a")
def a12(spark, d):
    return outcome_prediction(views.cases(spark, d), ["party"])


@query("a13_fire_stats", f"WITH {views.GEO} SELECT count(*) AS n, count(*) FILTER (k > 80) AS n_high, round(avg(confidence), 4) AS mean_brightness, (SELECT list(id ORDER BY id) FROM (SELECT id FROM geo ORDER BY ts, id LIMIT 5)) AS first_ids FROM geo")
def a13(spark, d):
    rows = views.geo_events(spark, d)
    first = rows.orderBy("ts", "id").limit(5).agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    return rows.agg(F.count("*").alias("n"), count_if(F.col("k") > 80).alias("n_high"), mean("confidence").alias("mean_brightness")).crossJoin(F.broadcast(first))


@query("a14_regional_profile", f"WITH {views.CASES} SELECT place, month(day) AS month, count(*) AS n, round(avg(CASE WHEN night THEN 1.0 ELSE 0.0 END), 4) AS night_ratio FROM cases GROUP BY place, month(day)")
def a14(spark, d):
    return views.cases(spark, d).groupBy("place", F.month("day").cast("long").alias("month")).agg(F.count("*").alias("n"), mean(F.col("night").cast("int")).alias("night_ratio"))


@query("a15_repeat_locations", f"WITH {views.CASES} SELECT place, count(*) AS n, round(avg(CASE WHEN night THEN 1.0 ELSE 0.0 END), 4) AS night_ratio FROM cases WHERE day >= (SELECT max(day) FROM cases) - INTERVAL 30 DAY GROUP BY place HAVING count(*) >= 3")
def a15(spark, d):
    rows = recent(views.cases(spark, d), "day", 30)
    return rows.groupBy("place").agg(F.count("*").alias("n"), mean(F.col("night").cast("int")).alias("night_ratio")).where("n >= 3")


def risk_nodes(frame: DataFrame, max_risk: float, least: float = 0.3) -> DataFrame:
    """Cells of a tenth of a degree; the risk grows by 0.2 an event up to 1, times one plus the weather's."""
    cells = frame.groupBy(F.round("lat", 1).alias("cell_lat"), F.round("lon", 1).alias("cell_lon")).agg(F.count("*").alias("n"))
    return cells.withColumn("risk", F.round(F.least(F.lit(1.0), F.col("n") * 0.2) * (1 + max_risk / 100), 4)).where(F.col("risk") > least)


@query("a16_risk_grid", f"WITH {views.GEO} SELECT round(lat, 1) AS cell_lat, round(lon, 1) AS cell_lon, count(*) AS n, round(least(1.0, count(*) * 0.2)::DOUBLE * 1.4, 4) AS risk FROM geo WHERE type = 'error' GROUP BY 1, 2 HAVING round(least(1.0, count(*) * 0.2) * 1.4, 4) > 0.3")
def a16(spark, d):
    return risk_nodes(views.geo_events(spark, d).where("type = 'error'"), 40.0)


@query("a17_sector_reliability", f"WITH {views.GEO} SELECT CAST(floor(lat) AS BIGINT) AS sector, count(*) AS n, round(avg(CASE WHEN k >= 40 THEN 1.0 ELSE 0.0 END), 4) AS reliability FROM geo GROUP BY 1")
def a17(spark, d):
    return views.geo_events(spark, d).groupBy(F.floor("lat").alias("sector")).agg(F.count("*").alias("n"), mean((F.col("k") >= 40).cast("int")).alias("reliability"))


@query("a18_satisfaction", f"WITH {views.LOG}, r AS (SELECT module, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 END AS rating FROM log) SELECT module, round(100.0 * count(*) FILTER (rating >= 4) / count(rating), 2) AS satisfied_pct, count(*) FILTER (coalesce(rating, 5) < 3) AS n_low FROM r GROUP BY module")
def a18(spark, d):
    rows = views.review_log(spark, d).select("module", F.when(F.col("k") % 6 != 0, F.col("k") % 6).alias("rating"))
    return rows.groupBy("module").agg(F.round(100.0 * count_if(F.col("rating") >= 4) / F.nullif(F.count("rating"), F.lit(0)), 2).alias("satisfied_pct"), count_if(F.coalesce("rating", F.lit(5)) < 3).alias("n_low"))


def term_counts(frame: DataFrame, text: str, stop: tuple = (), least: int = 5) -> DataFrame:
    """Words longer than `least` - 1 letters, their number and where they first stood."""
    words = frame.select(F.posexplode(F.split(F.lower(text), r"[^a-zà-ÿ]+")).alias("pos", "word"))
    return words.where((F.length("word") >= least) & ~F.col("word").isin(*stop)).groupBy("word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("a19_knowledge_gap_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS word FROM conversations WHERE role = 'user') WHERE length(word) > 4 GROUP BY word ORDER BY n DESC, word LIMIT 5")
def a19(spark, d):
    return term_counts(table(spark, d, "conversations").where("role = 'user'"), "text").orderBy(F.desc("n"), "word").limit(5).select("word", "n")


@query("a20_keywords", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS word FROM benchmark) WHERE length(word) >= 4 AND word NOT IN ('that', 'this', 'with', 'from') GROUP BY word ORDER BY n DESC, word LIMIT 20")
def a20(spark, d):
    return term_counts(table(spark, d, "benchmark"), "text", ("that", "this", "with", "from"), 4).orderBy(F.desc("n"), "word").limit(20).select("word", "n")


@query("a21_batch_distributions", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'size', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END, count(*) FROM documents GROUP BY 2")
def a21(spark, d):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return distributions(table(spark, d, "documents", "lang", "source", "n_chars").withColumn("size", size), ["lang", "source", "size"])


@query("a22_permit_stats", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS approved, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 2) AS rejection_pct, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS volume FROM orders")
def a22(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(
        F.count("*").alias("n"), count_if(status == "F").alias("approved"), F.round(100.0 * count_if(status == "O") / F.count("*"), 2).alias("rejection_pct"),
        F.round(F.sum(F.when(status == "F", F.col("o_totalprice")).cast("decimal(18,2)")), 2).cast("double").alias("volume"),
    )


@query("a23_frequent_mentions", "WITH m AS (SELECT l_orderkey AS chunk, l_partkey AS mention, l_discount * 10 AS score FROM lineitem), f AS (SELECT mention, count(*) AS freq FROM m GROUP BY mention), j AS (SELECT m.*, freq FROM m JOIN f USING (mention)) SELECT chunk, count(*) AS n_before, count(*) FILTER (freq >= 30 AND score >= 0.3) AS n_after, round(100.0 * (count(*) - count(*) FILTER (freq >= 30 AND score >= 0.3)) / count(*), 2) AS reduction_pct FROM j GROUP BY chunk")
def a23(spark, d):
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("mention"), (F.col("l_discount") * 10).alias("score"))
    rows = mentions.join(mentions.groupBy("mention").agg(F.count("*").alias("freq")), "mention")
    kept = count_if((F.col("freq") >= 30) & (F.col("score") >= 0.3))
    return rows.groupBy("chunk").agg(F.count("*").alias("n_before"), kept.alias("n_after"), F.round(100.0 * (F.count("*") - kept) / F.count("*"), 2).alias("reduction_pct"))


@query("a24_entity_registry", "SELECT l_partkey AS entity, count(*) AS frequency, count(DISTINCT l_suppkey) AS mentions, count(DISTINCT l_orderkey) AS chunks, min(l_orderkey) AS first_doc, max(l_orderkey) AS last_doc, list_sort(list(DISTINCT l_returnflag)) AS aliases FROM lineitem GROUP BY l_partkey")
def a24(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(
        F.count("*").alias("frequency"), F.count_distinct("l_suppkey").alias("mentions"), F.count_distinct("l_orderkey").alias("chunks"),
        F.min("l_orderkey").alias("first_doc"), F.max("l_orderkey").alias("last_doc"), F.array_sort(F.collect_set("l_returnflag")).alias("aliases"),
    )


@query("a25_graph_audit", f"WITH {views.NODES}, {views.EDGES} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type")
def a25(spark, d):
    labels = views.nodes(spark, d).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    types = views.edges(spark, d).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    return labels.unionByName(types)


def graph_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, edges a node and density E / (n (n - 1))."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    return n.crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges")))).select(
        "n_nodes", "n_edges", share(F.col("n_edges"), F.col("n_nodes")).alias("edges_per_node"), share(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1), 8).alias("density")
    )


@query("a26_graph_density", f"WITH {views.NODES}, {views.EDGES}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges) SELECT n AS n_nodes, e AS n_edges, round(e / n, 4) AS edges_per_node, round(e / (n * (n - 1)), 8) AS density FROM n, e")
def a26(spark, d):
    return graph_numbers(views.nodes(spark, d), views.edges(spark, d))


@query("a27_graph_quality", f"WITH {views.NODES}, {views.EDGES}, c AS (SELECT avg(CASE WHEN name IS NOT NULL AND name <> '' THEN 1.0 ELSE 0.0 END) AS completeness FROM nodes), s AS (SELECT avg(CASE WHEN n.node_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS consistency FROM edges e LEFT JOIN nodes n ON n.node_id = e.dst), r AS (SELECT least(1.0, (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)) AS richness) SELECT round(0.4 * completeness + 0.3 * consistency + 0.3 * richness, 4) AS quality FROM c, s, r")
def a27(spark, d):
    nodes, edges = views.nodes(spark, d), views.edges(spark, d)
    complete = nodes.agg(F.avg((F.col("name").isNotNull() & (F.col("name") != "")).cast("int")).alias("c"), F.count("*").alias("n"))
    known = edges.join(nodes.select(F.col("node_id").alias("dst"), F.lit(1).alias("known")), "dst", "left").agg(F.avg(F.coalesce("known", F.lit(0))).alias("s"), F.count("*").alias("e"))
    return complete.crossJoin(F.broadcast(known)).select(F.round(0.4 * F.col("c") + 0.3 * F.col("s") + 0.3 * F.least(F.lit(1.0), F.col("e") / F.col("n")), 4).alias("quality"))


@query("a28_mapping_indicators", f"WITH {views.NODES} SELECT round(count(DISTINCT label) / 10.0, 4) AS diversity, round(avg(length(name)), 4) AS richness, round(avg(CASE WHEN name LIKE '%1%' THEN 1.0 ELSE 0.0 END), 4) AS specificity FROM nodes")
def a28(spark, d):
    return views.nodes(spark, d).agg(F.round(F.count_distinct("label") / 10.0, 4).alias("diversity"), mean(F.length("name")).alias("richness"), mean(F.contains("name", F.lit("1")).cast("int")).alias("specificity"))


def confidence_bands(frame: DataFrame, by: str, confidence: str) -> DataFrame:
    """Links of high (0.8 and over), middle (0.5) and low confidence."""
    c = F.col(confidence)
    return frame.groupBy(by).agg(count_if(c >= 0.8).alias("high"), count_if((c >= 0.5) & (c < 0.8)).alias("middle"), count_if(c < 0.5).alias("low"), mean(c).alias("mean_confidence"))


@query("a29_link_bands", "SELECT l_returnflag AS method, count(*) FILTER (l_quantity / 50 >= 0.8) AS high, count(*) FILTER (l_quantity / 50 >= 0.5 AND l_quantity / 50 < 0.8) AS middle, count(*) FILTER (l_quantity / 50 < 0.5) AS low, round(avg(l_quantity / 50), 4) AS mean_confidence FROM lineitem GROUP BY 1")
def a29(spark, d):
    return confidence_bands(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), (F.col("l_quantity") / 50).alias("c")), "method", "c")


#: Members of a chunk up to which its pairs are less than bitmaps of its members would take.
LARGE_CHUNK = 1000
#: Pairs, repeated ones counted, that one task makes distinct.
PAIRS = 1_000_000


def neighbour_counts(members: DataFrame, large: int = LARGE_CHUNK) -> DataFrame:
    """Of each node v of the distinct (c, v) its other nodes that share a chunk c, as (v, degree); nodes without any are left out.

    Chunks of up to `large` members give pairs, at most `large` a membership, made distinct PAIRS a task. Larger ones give none: their members
    are numbered, each chunk is a bitmap by ranges of 32,768 numbers, and nodes of the same large chunks
    are one class, told by two hashes of 64 bits, whose bitmaps are OR-ed once. A pair from a small chunk counts only
    where the bitmap of v's class lacks w. Null chunks and nodes are no members.
    """
    sizes = members.groupBy("c").agg(F.count("*").alias("n"))
    sized = stage(members.join(sizes, "c"), "chunk-members")
    small, big = sized.where(F.col("n") <= large).select("c", "v"), sized.where(F.col("n") > large).select("c", "v")
    n_pairs = sized.where(F.col("n") <= large).agg(F.sum(F.col("n") - 1)).first()[0] or 0
    pairs = small.join(small.select("c", F.col("v").alias("w")), "c").where("v != w").select("v", "w").repartition(max(1, -(-n_pairs // PAIRS)), "v", "w").distinct()
    if big.isEmpty():
        return pairs.groupBy("v").agg(F.count("*").alias("degree"))
    number = F.col("_number") + 1
    numbers = numbered(big.select("v").distinct(), "chunk-nodes", "v").select("v", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    classes = big.groupBy("v").agg(F.bit_xor(F.xxhash64("c")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("h2"))
    nodes = stage(numbers.join(classes, "v"), "chunk-classes")
    chunks = big.join(nodes.select("v", "bucket", "bit"), "v").groupBy("c", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    one = nodes.groupBy("h1", "h2").agg(F.min("v").alias("v"))  # a node stands for its class
    reached = stage(one.join(big, "v").select("h1", "h2", "c").join(chunks, "c").groupBy("h1", "h2", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "chunk-unions")
    whole = nodes.select("v", "h1", "h2").join(reached.groupBy("h1", "h2").agg(F.sum(F.bitmap_count("bits")).alias("n")), ["h1", "h2"]).select("v", (F.col("n") - 1).alias("degree"))
    place = nodes.select(F.col("v").alias("w"), "bucket", "bit")
    asked = pairs.join(nodes.select("v", "h1", "h2"), "v", "left").join(place, "w", "left").join(reached, ["h1", "h2", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return asked.where(~met).groupBy("v").agg(F.count("*").alias("degree")).unionByName(whole).groupBy("v").agg(F.sum("degree").alias("degree"))


def degree_centrality(members: DataFrame, chunk: str, node: str, large: int = LARGE_CHUNK) -> DataFrame:
    """Nodes that share a chunk are neighbours; degree / (n - 1)."""
    m = stage(members.select(F.col(chunk).alias("c"), F.col(node).alias("v")).where("c IS NOT NULL AND v IS NOT NULL").distinct(), "chunk-nodes")
    n = m.agg(F.count_distinct("v").alias("n"))
    return neighbour_counts(m, large).crossJoin(F.broadcast(n)).select(F.col("v").alias("node"), "degree", share(F.col("degree"), F.col("n") - 1, 6).alias("centrality"))


@query("a30_degree_centrality", "WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS v FROM lineitem), p AS (SELECT DISTINCT a.v, b.v AS w FROM m a JOIN m b ON a.c = b.c AND a.v <> b.v) SELECT v AS node, count(*) AS degree, round(count(*) / ((SELECT count(DISTINCT v) FROM m) - 1), 6) AS centrality FROM p GROUP BY v")
def a30(spark, d):
    return degree_centrality(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("a31_entity_types", "WITH e AS (SELECT unnest([p_type || ':' || p_name, 'BRAND:' || p_brand]) AS entity FROM part) SELECT split_part(entity, ':', 1) AS type, count(*) AS n, count(DISTINCT entity) AS n_names FROM e GROUP BY 1")
def a31(spark, d):
    entities = table(spark, d, "part").select(F.explode(F.array(F.concat_ws(":", "p_type", "p_name"), F.concat(F.lit("BRAND:"), F.col("p_brand")))).alias("entity"))
    return entities.groupBy(F.split_part("entity", F.lit(":"), F.lit(1)).alias("type")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_names"))


@query("a32_embedding_dimensions", "WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high FROM x GROUP BY pos")
def a32(spark, d):
    x = table(spark, d, "embeddings", "embedding").select(F.posexplode("embedding").alias("pos", "v")).select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
    return x.groupBy("pos").agg(mean("v", 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("a34_dedupe_sections", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def a34(spark, d):
    best = F.struct("n_chars", (-F.col("doc_id")).alias("o"))
    return table(spark, d, "documents", "source", "lang", "doc_id", "n_chars").groupBy("source", "lang").agg(F.max_by("doc_id", best).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("a35_section_statistics", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (n_chars > 2000) AS n_long, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang")
def a35(spark, d):
    return table(spark, d, "documents", "lang", "n_chars").groupBy("lang").agg(F.count("*").alias("n"), mean("n_chars").alias("mean_chars"), count_if(F.col("n_chars") > 2000).alias("n_long"), F.sum("n_chars").alias("total"))


@query("a36_merged_cross_references", "SELECT l_suppkey AS source, l_partkey % 100 AS target, l_linestatus AS type, max(l_discount) AS strength, list_sort(list(DISTINCT l_linenumber)) AS citations FROM lineitem GROUP BY 1, 2, 3")
def a36(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("target"), F.col("l_linestatus").alias("type")).agg(F.max("l_discount").alias("strength"), F.array_sort(F.collect_set("l_linenumber")).alias("citations"))


@query("a37_amendment_frequency", f"WITH {views.VERSIONS} SELECT section, min(effective) AS first, max(effective) AS last, count(DISTINCT year(effective)) AS years, round(count(*) / count(DISTINCT year(effective)), 4) AS per_year FROM versions GROUP BY section")
def a37(spark, d):
    years = F.count_distinct(F.year("effective"))
    return views.versions(spark, d).groupBy("section").agg(F.min("effective").alias("first"), F.max("effective").alias("last"), years.alias("years"), F.round(F.count("*") / years, 4).alias("per_year"))


@query("a38_amendment_conflicts", f"WITH {views.VERSIONS} SELECT section, effective, count(DISTINCT law) AS laws FROM versions GROUP BY section, effective HAVING count(DISTINCT law) > 1")
def a38(spark, d):
    return views.versions(spark, d).groupBy("section", "effective").agg(F.count_distinct("law").alias("laws")).where("laws > 1")


@query("a39_overall_confidence", "SELECT source, round(greatest(0.0, avg(CASE WHEN lang = 'en' THEN 0.9 ELSE 0.7 END) - least(0.3, 0.05 * count(*) FILTER (n_chars < 200))), 4) AS confidence FROM documents GROUP BY source")
def a39(spark, d):
    base = F.avg(F.when(F.col("lang") == "en", 0.9).otherwise(0.7))
    return table(spark, d, "documents", "source", "lang", "n_chars").groupBy("source").agg(F.round(F.greatest(F.lit(0.0), base - F.least(F.lit(0.3), 0.05 * count_if(F.col("n_chars") < 200))), 4).alias("confidence"))


def weighted_quality(metrics: DataFrame, key: str) -> DataFrame:
    """0.7 of the weighted mean of metrics and 0.3 of the mean over components; rows (key, component, score, weight)."""
    parts = metrics.groupBy(key, "component").agg(F.sum(F.col("score") * F.col("weight")).alias("sw"), F.sum("weight").alias("w"))
    return parts.groupBy(key).agg(F.round(0.7 * F.sum("sw") / F.sum("w") + 0.3 * F.avg(F.coalesce(F.col("sw") / F.nullif("w", F.lit(0.0)), F.lit(0.5))), 4).alias("quality"))


_METRICS = "metrics AS (SELECT doc_id, 'text' AS component, least(1.0, n_chars / 3000.0) AS score, 2.0 AS weight FROM documents UNION ALL SELECT doc_id, 'text', CASE WHEN contains(text, '|') THEN 0.2 ELSE 0.9 END, 1.0 FROM documents UNION ALL SELECT doc_id, 'profile', CASE WHEN lang = 'en' THEN 1.0 ELSE 0.6 END, 1.5 FROM documents)"


def document_metrics(spark, d):
    docs = table(spark, d, "documents")
    metric = lambda c, s, w: F.struct(F.lit(c).alias("component"), s.cast("double").alias("score"), F.lit(w).alias("weight"))
    rows = F.array(
        metric("text", F.least(F.lit(1.0), F.col("n_chars") / 3000.0), 2.0), metric("text", F.when(F.contains("text", F.lit("|")), 0.2).otherwise(0.9), 1.0),
        metric("profile", F.when(F.col("lang") == "en", 1.0).otherwise(0.6), 1.5),
    )
    return docs.select("doc_id", F.inline(rows))


@query("a40_weighted_quality", f"WITH {_METRICS}, p AS (SELECT doc_id, component, sum(score * weight) AS sw, sum(weight) AS w FROM metrics GROUP BY 1, 2) SELECT doc_id, round(0.7 * sum(sw) / sum(w) + 0.3 * avg(sw / w), 4) AS quality FROM p GROUP BY doc_id")
def a40(spark, d):
    return weighted_quality(document_metrics(spark, d), "doc_id")


def gates(metrics: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """PASS at the threshold, WARN at 70% of it, else FAIL; the worst of a key's gates."""
    rank = F.when(F.col("score") >= threshold, 0).when(F.col("score") >= threshold * 0.7, 1).otherwise(2)
    rows = metrics.groupBy(key).agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 4).alias("score"), count_if(rank == 0).alias("n_passed"), F.max(rank).alias("worst"))
    return rows.withColumn("worst", F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("worst") + 1))


@query("a41_quality_gates", f"WITH {_METRICS} SELECT doc_id, round(sum(score * weight) / sum(weight), 4) AS score, count(*) FILTER (score >= 0.7) AS n_passed, CASE max(CASE WHEN score >= 0.7 THEN 0 WHEN score >= 0.7 * 0.7 THEN 1 ELSE 2 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS worst FROM metrics GROUP BY doc_id")
def a41(spark, d):
    return gates(document_metrics(spark, d), "doc_id")


@query("a42_segment_variance", "WITH s AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents) SELECT doc_id, round(var_pop(n), 4) AS variance FROM s GROUP BY doc_id")
def a42(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.round(F.var_pop(F.length("s")), 4).alias("variance"))


@query("a43_size_diversity", "SELECT p_brand, round(stddev_pop(p_size) / avg(p_size), 4) AS variation FROM part GROUP BY p_brand")
def a43(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.stddev_pop("p_size") / F.nullif(F.avg("p_size"), F.lit(0.0)), 4).alias("variation"))


@query("a44_prefix_clusters", "SELECT CAST(regexp_extract(CAST(c_custkey AS VARCHAR), '^([0-9]{1,2})', 1) AS INTEGER) AS prefix, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 3")
def a44(spark, d):
    return table(spark, d, "customer").groupBy(F.regexp_extract(F.col("c_custkey").cast("string"), "^([0-9]{1,2})", 1).cast("int").alias("prefix")).agg(F.count("*").alias("n")).where("n >= 3")


@query("a45_spatial_connectivity", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 97 AS b FROM lineitem WHERE l_suppkey <> l_partkey % 97), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT count(DISTINCT a) AS n FROM s) SELECT round((SELECT count(*) FROM s) / (n * (n - 1)), 6) AS connectivity FROM n")
def a45(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97).alias("b")).where("a != b").distinct()
    s = e.union(e.select("b", "a")).distinct()
    return s.agg(F.count("*").alias("links"), F.count_distinct("a").alias("n")).select(share(F.col("links"), F.col("n") * (F.col("n") - 1), 6).alias("connectivity"))


@query("a46_layout_consistency", "WITH l AS (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, round(avg(CASE WHEN p IS NOT NULL THEN least(n, p) / greatest(n, p) END), 4) AS similarity, round(stddev_pop(n) / avg(n), 4) AS variation FROM l GROUP BY conv_id")
def a46(spark, d):
    n = F.length("text")
    rows = table(spark, d, "conversations").select("conv_id", n.alias("n"), F.lag(n).over(Window.partitionBy("conv_id").orderBy("turn")).alias("p"))
    return rows.groupBy("conv_id").agg(mean(F.least("n", "p") / F.when(F.col("p").isNotNull(), F.nullif(F.greatest("n", "p"), F.lit(0)))).alias("similarity"), F.round(F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0)), 4).alias("variation"))


@query("a48_weighted_coverage", "WITH t AS (SELECT DISTINCT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)), v AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)) SELECT doc_id, round(sum(CASE WHEN v.term IS NOT NULL THEN CASE WHEN length(t.term) > 6 THEN 2 ELSE 1 END ELSE 0 END) / sum(CASE WHEN length(t.term) > 6 THEN 2 ELSE 1 END), 4) AS coverage FROM t LEFT JOIN v ON v.term = t.term GROUP BY doc_id")
def a48(spark, d):
    terms = lambda f: f.select(*[c for c in f.columns if c != "text"], F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    t = terms(table(spark, d, "documents", "doc_id", "text")).select("doc_id", F.lower("w").alias("term")).distinct()
    v = terms(table(spark, d, "benchmark", "text")).select(F.lower("w").alias("term")).distinct().withColumn("known", F.lit(1))
    weight = F.when(F.length("term") > 6, 2).otherwise(1)
    return t.join(v, "term", "left").groupBy("doc_id").agg(F.round(F.sum(F.coalesce("known", F.lit(0)) * weight) / F.sum(weight), 4).alias("coverage"))


@query("a49_reconcile_responses", f"WITH {views.LOG} SELECT document, round(avg(k / 100.0) * CASE WHEN bool_or(severity = 'critical') THEN 0.5 ELSE 1.0 END, 4) AS confidence, arg_max(id, (k, -id)) FILTER (NOT expert) AS primary_id FROM log GROUP BY document")
def a49(spark, d):
    return views.review_log(spark, d).groupBy("document").agg(
        F.round(F.avg(F.col("k") / 100.0) * F.when(F.bool_or(F.col("severity") == "critical"), 0.5).otherwise(1.0), 4).alias("confidence"),
        F.max_by("id", F.when(~F.col("expert"), F.struct(F.col("k"), (-F.col("id")).alias("o")))).alias("primary_id"),
    )


@query("a50_confidence_engine", f"WITH {views.LOG} SELECT document, round(least(0.98, greatest(0.35, 0.6::DOUBLE + 0.02 * least(10, count(*) FILTER (status = 'auto_resolved')) - 0.03 * count(*) FILTER (severity = 'critical') + CASE WHEN bool_or(expert) THEN 0.05 ELSE 0 END)), 4) AS confidence FROM log GROUP BY document")
def a50(spark, d):
    score = 0.6 + 0.02 * F.least(F.lit(10), count_if(F.col("status") == "auto_resolved")) - 0.03 * count_if(F.col("severity") == "critical") + F.when(F.bool_or("expert"), 0.05).otherwise(0)
    return views.review_log(spark, d).groupBy("document").agg(F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.35), score)), 4).alias("confidence"))


@query("a51_cluster_aggregate", f"WITH {views.GEO} SELECT source AS cluster, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(ts) AS last, count(DISTINCT type) AS types, max(k) AS confidence, count(*) AS size FROM geo GROUP BY source")
def a51(spark, d):
    return views.geo_events(spark, d).groupBy(F.col("source").alias("cluster")).agg(mean("lat", 6).alias("lat"), mean("lon", 6).alias("lon"), F.max("ts").alias("last"), F.count_distinct("type").alias("types"), F.max("k").alias("confidence"), F.count("*").alias("size"))


def scenario_grid(spark, mix: DataFrame, scenarios: list[tuple[str, float]], years: int) -> DataFrame:
    """Losses of a weighted stock by scenario and year, with running totals."""
    per_tree = mix.agg((F.sum(F.col("share") * F.col("per_tree")) / F.sum("share")).alias("per_tree"))
    rows = spark.createDataFrame(scenarios, "scenario string, trees double").select("scenario", "trees", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year"))
    w = Window.partitionBy("scenario").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return rows.crossJoin(F.broadcast(per_tree)).select("scenario", F.col("year").cast("long").alias("year"), F.round(F.sum("trees").over(w), 4).alias("total_trees"), F.round(F.sum(F.col("trees") * F.col("per_tree")).over(w), 4).alias("total_loss"))


@query("a52_carbon_grid", "WITH p AS (SELECT sum(p_size * p_retailprice / 1000) / sum(p_size) AS t FROM part), s AS (SELECT * FROM (VALUES ('low', 10.0), ('base', 25.0), ('high', 60.0)) x(scenario, trees)), y AS (SELECT unnest(range(1, 11)) AS year) SELECT scenario, year, round(sum(trees::DOUBLE) OVER w, 4) AS total_trees, round(sum(trees * t) OVER w, 4) AS total_loss FROM s, y, p WINDOW w AS (PARTITION BY scenario ORDER BY year ROWS UNBOUNDED PRECEDING)")
def a52(spark, d):
    mix = table(spark, d, "part").select(F.col("p_size").alias("share"), (F.col("p_retailprice") / 1000).alias("per_tree"))
    return scenario_grid(spark, mix, [("low", 10.0), ("base", 25.0), ("high", 60.0)], 10)


@query("a53_corpus_audit", "WITH m AS (SELECT l_orderkey AS doc, l_suppkey AS entity FROM lineitem), c AS (SELECT doc, entity, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, entity) AS rn FROM c) SELECT doc, sum(n)::BIGINT AS n_chunks, list(entity ORDER BY rn) FILTER (rn <= 5) AS top FROM r GROUP BY doc")
def a53(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "entity")))
    return ranked.groupBy("doc").agg(F.sum("n").alias("n_chunks"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "entity")))), lambda x: x["entity"]).alias("top"))


@query("a54_conversation_stats", "SELECT role, count(*) AS n, sum(length(text) // 4)::BIGINT AS tokens, round(avg(length(text) // 4), 4) AS mean_tokens FROM conversations GROUP BY role")
def a54(spark, d):
    tokens = F.floor(F.length("text") / 4)
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), mean(tokens).alias("mean_tokens"))


@query("a55_temporal_span", f"WITH {views.VERSIONS} SELECT section, min(year(effective)) AS first_year, max(year(effective)) AS last_year, max(year(effective)) - min(year(effective)) + 1 AS span, count(*) AS n FROM versions GROUP BY section")
def a55(spark, d):
    y = F.year("effective").cast("long")
    return views.versions(spark, d).groupBy("section").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), (F.max(y) - F.min(y) + 1).alias("span"), F.count("*").alias("n"))


@query("a56_text_density", f"WITH {views.GEO} SELECT type, round(sum(confidence * k) / 1e6, 6) AS density, min(lat) AS top, max(lat) AS bottom, min(lon) AS left_edge, max(lon) AS right_edge FROM geo GROUP BY type")
def a56(spark, d):
    return views.geo_events(spark, d).groupBy("type").agg(F.round(F.sum(F.col("confidence") * F.col("k")) / 1e6, 6).alias("density"), F.min("lat").alias("top"), F.max("lat").alias("bottom"), F.min("lon").alias("left_edge"), F.max("lon").alias("right_edge"))


@query("a57_bail_share", f"WITH {views.CASES}, p AS (SELECT party, coalesce(avg(CASE verdict WHEN 'acquitted' THEN 1.0 WHEN 'guilty' THEN 0.0 END), 0.5) AS base, count(*) FILTER (verdict = 'guilty') AS prior FROM cases GROUP BY party) SELECT party, round(least(0.99, greatest(0.01, CASE WHEN prior >= 5 THEN base * 0.4 ELSE base + 0.2 * (1 - base) END)), 4) AS granted FROM p")
def a57(spark, d):
    won = F.when(F.col("verdict") == "acquitted", 1.0).when(F.col("verdict") == "guilty", 0.0)
    rows = views.cases(spark, d).groupBy("party").agg(F.coalesce(F.avg(won), F.lit(0.5)).alias("base"), count_if(F.col("verdict") == "guilty").alias("prior"))
    granted = F.when(F.col("prior") >= 5, F.col("base") * 0.4).otherwise(F.col("base") + 0.2 * (1 - F.col("base")))
    return rows.select("party", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), granted)), 4).alias("granted"))


@query("a58_rule_verification", f"WITH {_METRICS}, v AS (SELECT doc_id, component, score >= 0.5 AS passed FROM metrics) SELECT doc_id, count(*) FILTER (NOT passed) = 0 OR (count(*) FILTER (NOT passed) = 1 AND bool_or(NOT passed AND component = 'profile')) AS verified FROM v GROUP BY doc_id")
def a58(spark, d):
    rows = document_metrics(spark, d).select("doc_id", "component", (F.col("score") >= 0.5).alias("passed"))
    failed = count_if(~F.col("passed"))
    return rows.groupBy("doc_id").agg(((failed == 0) | ((failed == 1) & F.bool_or(~F.col("passed") & (F.col("component") == "profile")))).alias("verified"))


