"""Predicates and projections over records, chunks and graph properties."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.runtime import table

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_rank(column: str = "severity") -> Column:
    """Severities in order of rank, never as text."""
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def dynamic_filter(frame: DataFrame, equal: dict | None = None, between: dict | None = None, has: dict | None = None, order: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """whatever predicates are given, all of them; columns that are not there fail."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c) >= low for c, (low, _) in (between or {}).items() if low is not None]
    tests += [F.col(c) <= high for c, (_, high) in (between or {}).items() if high is not None]
    tests += [F.array_contains(c, v) for c, v in (has or {}).items()]
    out = frame.where(reduce(and_, tests)) if tests else frame
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


@query("f1_dynamic_filter", f"WITH {views.LOG} SELECT id, type, gap FROM log WHERE severity = 'high' AND stage = 's1' AND gap >= 20 AND gap <= 80 AND day >= DATE '2024-01-05' ORDER BY gap DESC, id LIMIT 50 OFFSET 10")
def f1(spark, d):
    log = views.review_log(spark, d)
    return dynamic_filter(log, {"severity": "high", "stage": "s1", "module": None}, {"gap": (20, 80), "day": (F.lit("2024-01-05").cast("date"), None)}, order=[F.desc("gap"), "id"], limit=50, offset=10).select("id", "type", "gap")


@query("f2_exact_metadata_match", f"WITH {views.LOG} SELECT id FROM log WHERE module = 'm3' AND type = 'click' AND expert")
def f2(spark, d):
    return dynamic_filter(views.review_log(spark, d), {"module": "m3", "type": "click", "expert": True}).select("id")


def typed_filters(frame: DataFrame, entity_type: str | None = None, min_confidence: float | None = None, exclude: Column | None = None) -> DataFrame:
    """entity type by prefix, confidence with 1.0 where missing, an exclusion flag."""
    tests = [F.lit(True)]
    if entity_type:
        tests.append(F.exists("entities", lambda e: F.split_part(e, F.lit(":"), F.lit(1)) == entity_type))
    if min_confidence is not None:
        tests.append(F.coalesce(F.col("confidence"), F.lit(1.0)) >= min_confidence)
    if exclude is not None:
        tests.append(~F.coalesce(exclude, F.lit(False)))
    return frame.where(reduce(and_, tests))


@query("f3_typed_chunk_filters", "SELECT p_partkey AS chunk FROM part WHERE p_type = 'PROMO' AND coalesce(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 50.0 END, 1.0) >= 0.4 AND p_brand <> 'Brand#3'")
def f3(spark, d):
    chunks = table(spark, d, "part").select(
        F.col("p_partkey").alias("chunk"), F.array(F.concat(F.col("p_type"), F.lit(":"), F.col("p_name")), F.concat(F.lit("brand:"), F.col("p_brand"))).alias("entities"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0).alias("confidence"), (F.col("p_brand") == "Brand#3").alias("excluded"),
    )
    return typed_filters(chunks, "PROMO", 0.4, F.col("excluded")).select("chunk")


def incomplete(frame: DataFrame, columns: list[str], sentinels=("", "N/A", "n/a", "None", "null", "unknown")) -> DataFrame:
    """rows of which a needed column is missing, by null or by a word for it."""
    return frame.where(reduce(or_, [F.col(c).isNull() | F.col(c).isin(*sentinels) for c in columns]))


@query("f4_audit_incomplete", "SELECT p_partkey FROM part WHERE (CASE WHEN p_size % 11 = 0 THEN 'N/A' ELSE p_type END) = 'N/A' OR (CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_brand END) IS NULL")
def f4(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 11 == 0, "N/A").otherwise(F.col("p_type")).alias("law"), F.when(F.col("p_size") % 13 != 0, F.col("p_brand")).alias("section"))
    return incomplete(part, ["law", "section"]).select("p_partkey")


def first_substring(column: str, names: list[str], default: str | None = None) -> Column:
    """the first of an ordered list that the text contains."""
    out = F.lit(default)
    for name in reversed(names):
        out = F.when(F.contains(F.lower(column), F.lit(name.lower())), name).otherwise(out)
    return out


@query("f5_first_zone_in_text", "SELECT doc_id, CASE WHEN contains(lower(text), 'tionre') THEN 'tionre' WHEN contains(lower(text), 'thand') THEN 'thand' WHEN contains(lower(text), 'que') THEN 'que' END AS zone FROM documents")
def f5(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", first_substring("text", ["tionre", "thand", "que"]).alias("zone"))


def recent(frame: DataFrame, time: str, days: int, as_of=None) -> DataFrame:
    """F7, ST7: the last `days` days before `as_of`, or before the latest row; times that don't parse are left out."""
    when = F.to_timestamp(F.col(time))
    end = frame.agg(F.max(when).alias("_end")) if as_of is None else None
    if end is None:
        return frame.where(when >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return frame.crossJoin(F.broadcast(end)).where(when >= F.col("_end") - F.expr(f"INTERVAL {days} DAYS")).drop("_end")  # one row


@query("f6_recent_severe_by_type", f"WITH {views.LOG}, last AS (SELECT max(ts) AS e FROM log) SELECT type, count(*) AS n, list(id ORDER BY id) AS ids FROM log, last WHERE ts >= e - INTERVAL 3 DAY AND severity IN ('high', 'critical') AND type IN ('error', 'purchase') GROUP BY type")
def f6(spark, d):
    rows = recent(views.review_log(spark, d), "ts", 3).where((severity_rank() >= 3) & F.col("type").isin("error", "purchase"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


@query("f7_recent_incidents", "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS day FROM orders WHERE try_cast(CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) >= DATE '2001-08-01' - INTERVAL 30 DAY")
def f7(spark, d):
    text = F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.to_date("o_orderdate").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.try_to_date(text).alias("day"))
    return rows.where(F.col("day") >= F.date_sub(F.lit("2001-08-01").cast("date"), 30))


def first_pool(frame: DataFrame, priority: Column, key: list[str] | None = None) -> DataFrame:
    """Of pools in order of priority the first that has rows (per key)."""
    scored = frame.withColumn("_p", priority).where("_p IS NOT NULL")
    best = scored.groupBy(*(key or [])).agg(F.min("_p").alias("_best"))
    joined = scored.join(best, key) if key else scored.crossJoin(F.broadcast(best))
    return joined.where("_p = _best").drop("_p", "_best")


@query("f8_cascading_pools", f"WITH {views.LOG}, p AS (SELECT *, CASE WHEN severity = 'critical' AND type = 'none' THEN 1 WHEN severity = 'critical' AND type = 'error' THEN 2 WHEN severity = 'critical' THEN 3 END AS pr FROM log) SELECT id, gap FROM p WHERE pr = (SELECT min(pr) FROM p) ORDER BY gap DESC, id LIMIT 3")
def f8(spark, d):
    critical = F.col("severity") == "critical"
    pools = F.when(critical & (F.col("type") == "none"), 1).when(critical & (F.col("type") == "error"), 2).when(critical, 3)
    return first_pool(views.review_log(spark, d), pools).orderBy(F.desc("gap"), "id").limit(3).select("id", "gap")


@query("f9_applications_of_one_party", f"WITH {views.CASES} SELECT case_id, day FROM cases WHERE party = 42 AND day >= DATE '1998-01-01'")
def f9(spark, d):
    return dynamic_filter(views.cases(spark, d), {"party": 42}, {"day": (F.lit("1998-01-01").cast("date"), None)}).select("case_id", "day")


def route_by_box(lat: Column, lon: Column, boxes: list[tuple], default: str) -> Column:
    """The first box (name, south, north, west, east) that holds a point."""
    out = F.lit(default)
    for name, south, north, west, east in reversed(boxes):
        out = F.when(lat.between(south, north) & lon.between(west, east), name).otherwise(out)
    return out


BOXES = [("north", 31.0, 32.0, 70.0, 71.5), ("centre", 30.5, 31.5, 70.5, 71.5), ("south", 30.0, 30.6, 70.0, 72.0)]


@query("f10_dispatch_by_box", f"WITH {views.GEO} SELECT id, CASE WHEN lat BETWEEN 31 AND 32 AND lon BETWEEN 70 AND 71.5 THEN 'north' WHEN lat BETWEEN 30.5 AND 31.5 AND lon BETWEEN 70.5 AND 71.5 THEN 'centre' WHEN lat BETWEEN 30 AND 30.6 AND lon BETWEEN 70 AND 72 THEN 'south' ELSE 'headquarters' END AS target FROM geo")
def f10(spark, d):
    return views.geo_events(spark, d).select("id", route_by_box(F.col("lat"), F.col("lon"), BOXES, "headquarters").alias("target"))


@query("f11_chunk_classes", r"SELECT doc_id, lang IN ('en', 'fr') AS legal, n_chars > 2000 AS long, regexp_matches(text, '^[A-Z][a-z]+ [a-z]+\.') AS heading, regexp_matches(text, '(?m)^[^|\n]*\|[^|\n]*\|') AS tabular FROM documents")
def f11(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.col("lang").isin("en", "fr").alias("legal"), (F.col("n_chars") > 2000).alias("long"),
        F.col("text").rlike(r"^[A-Z][a-z]+ [a-z]+\.").alias("heading"), F.col("text").rlike(r"(?m)^[^|\n]*\|[^|\n]*\|").alias("tabular"),
    )


@query("f12_filter_by_intent", "SELECT doc_id FROM documents WHERE CASE lang WHEN 'en' THEN contains(lower(text), 'tion') WHEN 'fr' THEN n_chars > 1500 WHEN 'de' THEN source = 'src2' ELSE true END")
def f12(spark, d):
    keep = F.when(F.col("lang") == "en", F.contains(F.lower("text"), F.lit("tion"))).when(F.col("lang") == "fr", F.col("n_chars") > 1500).when(F.col("lang") == "de", F.col("source") == "src2").otherwise(True)
    return table(spark, d, "documents").where(keep).select("doc_id")


def filter_or_all(frame: DataFrame, test: Column) -> DataFrame:
    """the rows that pass, or all rows where none does."""
    return first_pool(frame, F.when(test, 1).otherwise(2))


@query("f13_filter_or_everything", "WITH t AS (SELECT p_partkey, p_name LIKE '%no such name%' AS hit FROM part) SELECT p_partkey FROM t WHERE hit OR NOT EXISTS (SELECT 1 FROM t WHERE hit)")
def f13(spark, d):
    return filter_or_all(table(spark, d, "part"), F.contains("p_name", F.lit("no such name"))).select("p_partkey")


def relaxed_threshold(frame: DataFrame, score: str, least: float, floor: float = 0.15) -> DataFrame:
    """rows at the threshold; if the best row is below it, those at half of it, `floor` at least."""
    best = frame.agg(F.max(score).alias("_max"))
    bound = F.when(F.col("_max") >= least, F.lit(least)).otherwise(F.lit(max(floor, least * 0.5)))
    return frame.crossJoin(F.broadcast(best)).where(F.col(score) >= bound).drop("_max")  # one row


@query("f14_relaxed_threshold", "WITH s AS (SELECT p_partkey, p_size / 100.0 AS score FROM part), m AS (SELECT max(score) AS x FROM s) SELECT p_partkey, score FROM s, m WHERE score >= CASE WHEN x >= 0.8 THEN 0.8 ELSE 0.4 END")
def f14(spark, d):
    return relaxed_threshold(table(spark, d, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("score")), "score", 0.8)


STOP = ("the", "and", "of", "to", "in", "la", "de", "que", "der", "die", "und")


@query("f15_mention_prefilter", "WITH m AS (SELECT DISTINCT doc_id, lower(w) AS mention FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)) SELECT mention, count(*) AS n FROM m WHERE length(mention) >= 4 AND mention NOT IN ('the','and','of','to','in','la','de','que','der','die','und') AND NOT regexp_matches(mention, '^[0-9.,]+$') GROUP BY mention")
def f15(spark, d):
    mentions = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.lower("w").alias("mention")).distinct()
    kept = mentions.where((F.length("mention") >= 4) & ~F.col("mention").isin(*STOP) & ~F.col("mention").rlike("^[0-9.,]+$"))
    return kept.groupBy("mention").agg(F.count("*").alias("n"))


@query("f16_suggestion_filter", "SELECT DISTINCT p_type AS type, p_name AS value, p_brand AS context FROM part WHERE length(p_name) >= 3 AND p_size / 50.0 >= 0.3 AND p_name NOT IN ('the', 'and')")
def f16(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("value"), F.col("p_brand").alias("context"), (F.col("p_size") / 50.0).alias("confidence"))
    return rows.where((F.length("value") >= 3) & (F.col("confidence") >= 0.3) & ~F.col("value").isin(*STOP)).select("type", "value", "context").distinct()


@query("f17_grounding_gate", "SELECT source, bool_or(lang = 'en' AND n_chars > 500) AS grounded, count(*) AS n FROM documents GROUP BY source")
def f17(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.bool_or((F.col("lang") == "en") & (F.col("n_chars") > 500)).alias("grounded"), F.count("*").alias("n"))


def suspicious(text: str) -> Column:
    """injection phrases, or over a tenth of the characters special."""
    special = F.length(text) - F.length(F.regexp_replace(text, r"[<>{}\[\]|\\^`]", ""))
    return F.lower(text).rlike(r"ignore (all |any )?(previous|prior) instructions|system prompt|<script") | (special * 10 > F.length(text))


@query("f18_injection_screen", r"SELECT doc_id, regexp_matches(lower(text), 'ignore (all |any )?(previous|prior) instructions|system prompt|<script') OR (length(text) - length(regexp_replace(text, '[<>{}\[\]|\\^`]', '', 'g'))) * 10 > length(text) AS suspicious FROM documents")
def f18(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", suspicious("text").alias("suspicious"))


@query("f19_rule_cascade", "SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'too_short' WHEN NOT contains(text, '.') THEN 'no_sentence' WHEN regexp_matches(text, '[0-9]{4}') THEN 'dated' ELSE 'valid' END AS verdict FROM documents")
def f19(spark, d):
    verdict = F.when(F.length(F.trim("text")) < 50, "too_short").when(~F.contains("text", F.lit(".")), "no_sentence").when(F.col("text").rlike("[0-9]{4}"), "dated").otherwise("valid")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", verdict.alias("verdict"))


@query("f20_registry_exclusion", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1 AND coalesce(l.toxic, 0) = 0")
def f20(spark, d):
    rows = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.where((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


@query("f21_high_confidence", f"WITH {views.GEO} SELECT id FROM geo WHERE lower(CASE WHEN k % 3 = 0 THEN 'H' WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) ELSE 'nominal' END) IN ('h', 'high') OR try_cast(CASE WHEN k % 3 = 1 THEN CAST(k AS VARCHAR) ELSE 'x' END AS INTEGER) > 80")
def f21(spark, d):
    mark = F.when(F.col("k") % 3 == 0, "H").when(F.col("k") % 3 == 1, F.col("k").cast("string")).otherwise("nominal")
    rows = views.geo_events(spark, d).withColumn("mark", mark)
    return rows.where(F.lower("mark").isin("h", "high") | (F.coalesce(F.expr("try_cast(mark AS INT)"), F.lit(0)) > 80)).select("id")


def flat_properties(frame: DataFrame) -> DataFrame:
    """F22, SRC32: complex columns as JSON text, the rest as they are."""
    return frame.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "map", "array<struct", "array<array")) else F.col(c) for c, t in frame.dtypes])


@query("f22_flatten_properties", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || CAST(p_size AS VARCHAR) || '}' AS detail, p_name FROM part""")
def f22(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("detail"), "p_name")
    return flat_properties(part)


@query("f23_heading_lines", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n - 1 AS line_no, regexp_extract(line, '^([A-ZÀ-Þ][a-zß-ÿ]*)\b', 1) AS mark FROM l WHERE regexp_matches(line, '^[A-Z][a-z]{1,12}\.$')")
def f23(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"^[A-Z][a-z]{1,12}\.$")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_extract("line", r"^([A-ZÀ-Þ][a-zß-ÿ]*)", 1).alias("mark"))


