"""Risk, penalty, confidence, authority and validity rules as expressions over parameter lists and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.functions.text import clamp
from quillmesh.operators import views
from quillmesh.operators.joins import HAVERSINE_SQL, haversine
from quillmesh.runtime import table


@query("fn23_haversine", f"WITH {views.GEO} SELECT id, round({HAVERSINE_SQL.format(a1='lat', a2='lon', b1='31.0', b2='71.0')}, 4) AS km FROM geo")
def fn23(spark, d):
    return views.geo_events(spark, d).select("id", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(31.0), F.lit(71.0)), 4).alias("km"))


def fire_risk(temp: Column, humidity: Column, wind: Column) -> Column:
    """FN24: heat, dryness and wind as a risk from 0 to 100. Dryness counts four fifths, as the double nearest to them: a product with 0.8 may lie beside it, on the other side of a half."""
    return clamp(F.round((F.least(temp, F.lit(45.0)) * 1.5 + (100 - humidity) * 8 / 10 + F.least(wind * 3.6, F.lit(50.0)) * 0.5) / 2.5), 0.0, 100.0)


@query("fn24_fire_risk", f"WITH {views.GEO} SELECT id, least(100.0, greatest(0.0, round((least(confidence, 45.0) * 1.5 + (100 - k) * 0.8 + least(k / 5.0 * 3.6, 50.0) * 0.5) / 2.5))) AS risk FROM geo")
def fn24(spark, d):
    return views.geo_events(spark, d).select("id", fire_risk(F.col("confidence"), F.col("k"), F.col("k") / 5.0).alias("risk"))


def compass(degrees: Column) -> Column:
    """FN25: one of eight winds."""
    return F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.pmod(F.floor((degrees + 22.5) / 45), F.lit(8)) + 1).cast("int"))


@query("fn25_threat_and_wind", f"WITH {views.GEO} SELECT id, round(least(100.0, k * (1 + 1 / (1 + exp(confidence / 10 - 5)))), 4) AS threat, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((k * 3.6 + 22.5) / 45) AS INTEGER) % 8 + 1] AS wind FROM geo")
def fn25(spark, d):
    threat = F.least(F.lit(100.0), F.col("k") * (1 + 1 / (1 + F.exp(F.col("confidence") / 10 - 5))))
    return views.geo_events(spark, d).select("id", F.round(threat, 4).alias("threat"), compass(F.col("k") * 3.6).alias("wind"))


@query("fn26_biomass_at_risk", "SELECT l_orderkey, l_linenumber, round(l_quantity * 3.14 * 0.25 * p_size * p_retailprice / 1000, 8) AS tonnes FROM lineitem JOIN part ON p_partkey = l_partkey")
def fn26(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 3.14 * 0.25 * F.col("p_size") * F.col("p_retailprice") / 1000, 8).alias("tonnes"))


@query("fn27_permit_fee", "SELECT l_orderkey, l_linenumber, (500 + 100 + CASE WHEN l_quantity > 20 THEN 250 ELSE 0 END + l_quantity * CASE l_returnflag WHEN 'R' THEN 12 WHEN 'A' THEN 8 ELSE 5 END + CASE WHEN l_discount > 0.05 THEN 75 ELSE 0 END)::DOUBLE AS fee FROM lineitem")
def fn27(spark, d):
    unit = F.when(F.col("l_returnflag") == "R", 12).when(F.col("l_returnflag") == "A", 8).otherwise(5)
    fee = 600 + F.when(F.col("l_quantity") > 20, 250).otherwise(0) + F.col("l_quantity") * unit + F.when(F.col("l_discount") > 0.05, 75).otherwise(0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fee.cast("double").alias("fee"))


@query("fn28_multiplied_penalty", "SELECT l_orderkey, l_linenumber, (100 * p_size * CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END * CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END * CASE WHEN p_type = 'PROMO' THEN 10 ELSE 1 END * l_quantity)::DOUBLE AS penalty FROM lineitem JOIN part ON p_partkey = l_partkey")
def fn28(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    times = F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(1) * F.when(F.col("l_returnflag") == "R", 2).otherwise(1) * F.when(F.col("p_type") == "PROMO", 10).otherwise(1)
    return rows.select("l_orderkey", "l_linenumber", (F.lit(100) * F.col("p_size") * times * F.col("l_quantity")).cast("double").alias("penalty"))


def decimal_penalty(base: Column, units: Column, rate: Column, floor: Column, offences: Column, surcharge: Column) -> Column:
    """FN29, FN30: base and units, a floor, repeat factors 1.5, 2 and 3, a percentage; decimal, rounded half up to whole."""
    repeat = F.when(offences >= 4, F.lit("3")).when(offences == 3, F.lit("2")).when(offences == 2, F.lit("1.5")).otherwise(F.lit("1")).cast("decimal(4,2)")
    amount = F.greatest((base + units * rate).cast("decimal(18,4)"), floor.cast("decimal(18,4)"))
    return F.round((amount * repeat).cast("decimal(24,6)") * (1 + surcharge / 100).cast("decimal(6,4)"), 0).cast("decimal(18,0)").cast("long")


@query("fn29_decimal_penalty_chain", "WITH x AS (SELECT l_orderkey, l_linenumber, greatest(CAST(1000 + l_quantity * 150 AS DECIMAL(18,4)), CAST(2500 AS DECIMAL(18,4))) AS amount, CASE WHEN l_linenumber >= 4 THEN 3 WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 2 THEN 1.5 ELSE 1 END AS rep, CASE WHEN l_returnflag = 'R' THEN 1.25 ELSE 1.0 END AS sur FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(round(CAST(amount AS DECIMAL(12,2)) * CAST(rep AS DECIMAL(4,2)) * CAST(sur AS DECIMAL(6,4)), 0) AS BIGINT) AS penalty FROM x")
def fn29(spark, d):
    surcharge = F.when(F.col("l_returnflag") == "R", 25).otherwise(0)
    amount = decimal_penalty(F.lit(1000), F.col("l_quantity").cast("decimal(10,2)"), F.lit(150), F.lit(2500), F.col("l_linenumber"), surcharge)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", amount.alias("penalty"))


@query("fn31_escalating_penalty", "SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'F' THEN 5000.0 ELSE round(1000 * l_quantity * (1 + 0.2 * (l_linenumber - 1)) / 100) * 100 END::DOUBLE AS penalty FROM lineitem")
def fn31(spark, d):
    grown = F.round(1000 * F.col("l_quantity") * (1 + 0.2 * (F.col("l_linenumber") - 1)) / 100) * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", 5000.0).otherwise(grown).alias("penalty"))


@query("fn46_trust", f"WITH {views.LOG} SELECT document, round(CASE WHEN bool_or(expert) THEN 1.0 ELSE 0.5 END * least(count(*) FILTER (severity = 'critical'), 3) / 3 * CASE WHEN bool_or(status = 'pending') THEN 0.8 ELSE 1.0 END, 4) AS trust FROM log GROUP BY document")
def fn46(spark, d):
    n = F.least(F.count_if(F.col("severity") == "critical"), F.lit(3)) / 3
    trust = F.when(F.bool_or("expert"), 1.0).otherwise(0.5) * n * F.when(F.bool_or(F.col("status") == "pending"), 0.8).otherwise(1.0)
    return views.review_log(spark, d).groupBy("document").agg(F.round(trust, 4).alias("trust"))


def contract_violations(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """FN48, GR8: a row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return frame.withColumn("rule", F.explode(broken))


@query("fn48_contract_checks", "SELECT o_orderkey, 'total' AS rule FROM orders WHERE NOT o_totalprice > 5000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT')")
def fn48(spark, d):
    rules = {"total": F.col("o_totalprice") > 5000, "status": (F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") != "1-URGENT")}
    return contract_violations(table(spark, d, "orders"), rules).select("o_orderkey", "rule")


@query("fn62_fn63_authority_rank", "WITH r AS (SELECT * FROM (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 1), ('5-LOW', 2)) x(name, rank)) SELECT o_orderkey, rank, rank > 3 AS can_override FROM orders JOIN r ON name = o_orderpriority")
def fn62(spark, d):
    ranks = spark.createDataFrame([("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 1), ("5-LOW", 2)], "name string, rank int")
    return table(spark, d, "orders").join(F.broadcast(ranks), F.col("name") == F.col("o_orderpriority")).select("o_orderkey", "rank", (F.col("rank") > 3).alias("can_override"))


def apply_rules(frame: DataFrame, rules: list[tuple[int, str, str]], default: str, column: str = "status") -> DataFrame:
    """FN64, U6: rules as data (priority, condition, action); the last that holds by priority wins. Conditions are compiled once."""
    out = F.lit(default)
    for _, condition, action in sorted(rules):
        out = F.when(F.expr(condition), action).otherwise(out)
    return frame.withColumn(column, out)


RULES = [(1, "penalty < 50000", "minor"), (2, "verdict = 'pending'", "waiting"), (3, "night AND penalty > 400000", "grave")]


@query("fn64_rule_table", f"WITH {views.CASES} SELECT case_id, CASE WHEN night AND penalty > 400000 THEN 'grave' WHEN verdict = 'pending' THEN 'waiting' WHEN penalty < 50000 THEN 'minor' ELSE 'valid' END AS status FROM cases")
def fn64(spark, d):
    return apply_rules(views.cases(spark, d), RULES, "valid").select("case_id", "status")


@query("fn65_chain_status", f"WITH {views.VERSIONS} SELECT section, CASE WHEN bool_and(action <> 'repealed') THEN 'valid' WHEN bool_and(action = 'repealed') THEN 'invalid' ELSE 'mixed' END AS status, round(least(1.0, 0.5 + 0.01 * count(*)), 4)::DOUBLE AS confidence FROM versions GROUP BY section")
def fn65(spark, d):
    repealed = F.col("action") == "repealed"
    status = F.when(F.bool_and(~repealed), "valid").when(F.bool_and(repealed), "invalid").otherwise("mixed")
    return views.versions(spark, d).groupBy("section").agg(status.alias("status"), F.round(F.least(F.lit(1.0), 0.5 + 0.01 * F.count("*")), 4).alias("confidence"))


@query("fn66_staleness", f"WITH {views.CASES} SELECT case_id, CASE WHEN DATE '2001-08-01' - day > 180 THEN 'stale' WHEN DATE '2001-08-01' - day > 90 THEN 'ageing' ELSE 'fresh' END AS state FROM cases")
def fn66(spark, d):
    age = F.datediff(F.lit("2001-08-01").cast("date"), "day")
    return views.cases(spark, d).select("case_id", F.when(age > 180, "stale").when(age > 90, "ageing").otherwise("fresh").alias("state"))


@query("fn67_gap_severity", f"WITH {views.LOG} SELECT id, CASE WHEN (0.8 - k / 100.0) * 1.5 >= 0.6 THEN 'critical' WHEN (0.8 - k / 100.0) * 1.5 >= 0.3 THEN 'high' WHEN k < 80 THEN 'medium' ELSE 'low' END AS severity, round(least(1.0, 0.3 + CASE WHEN expert THEN 0.4 ELSE 0 END + CASE WHEN type = 'error' THEN 0.5 ELSE 0 END), 4)::DOUBLE AS relevance FROM log")
def fn67(spark, d):
    gap = (F.lit(80) - F.col("k")) * 15
    severity = F.when(gap >= 600, "critical").when(gap >= 300, "high").when(F.col("k") < 80, "medium").otherwise("low")
    relevance = F.least(F.lit(1.0), 0.3 + F.when(F.col("expert"), 0.4).otherwise(0.0) + F.when(F.col("type") == "error", 0.5).otherwise(0.0))
    return views.review_log(spark, d).select("id", severity.alias("severity"), F.round(relevance, 4).alias("relevance"))


def overlap_of_smaller(a: dict, b: dict) -> Column:
    """FN68: intersection of two boxes over the smaller area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return w * h / F.nullif(F.least(area(a), area(b)), F.lit(0.0))


@query("fn68_box_overlap", f"WITH {views.GEO} SELECT id, round(greatest(0.0, least(lon + 0.5, 71.5) - greatest(lon, 70.5)) * greatest(0.0, least(lat + 0.5, 31.5) - greatest(lat, 30.5)) / least(0.25, 1.0), 4) AS overlap FROM geo")
def fn68(spark, d):
    a = {"x0": F.col("lon"), "x1": F.col("lon") + 0.5, "y0": F.col("lat"), "y1": F.col("lat") + 0.5}
    b = {"x0": F.lit(70.5), "x1": F.lit(71.5), "y0": F.lit(30.5), "y1": F.lit(31.5)}
    return views.geo_events(spark, d).select("id", F.round(overlap_of_smaller(a, b), 4).alias("overlap"))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """FN69: ray casting over the edges of a ring of (x, y)."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


TRIANGLE = [(70.2, 30.2), (71.8, 30.4), (71.0, 31.7)]


@query("fn69_point_in_polygon", f"WITH {views.GEO}, e AS (SELECT * FROM (VALUES (70.2::DOUBLE, 30.2::DOUBLE, 71.8::DOUBLE, 30.4::DOUBLE), (71.8, 30.4, 71.0, 31.7), (71.0, 31.7, 70.2, 30.2)) x(x1, y1, x2, y2)) SELECT id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM geo, e GROUP BY id")
def fn69(spark, d):
    return views.geo_events(spark, d).select("id", in_polygon(F.col("lon"), F.col("lat"), TRIANGLE).alias("inside"))


@query("fn70_quota_and_spam", f"WITH {views.CASES} SELECT party, round(least(100.0, 5 + 0.5 * count(*)), 2)::DOUBLE AS quota, count(*) FILTER (day >= DATE '2001-08-01' - INTERVAL 30 DAY) >= 3 AS spam FROM cases GROUP BY party")
def fn70(spark, d):
    late = F.count_if(F.col("day") >= F.date_sub(F.lit("2001-08-01").cast("date"), 30))
    return views.cases(spark, d).groupBy("party").agg(F.round(F.least(F.lit(100.0), 5 + 0.5 * F.count("*")), 2).alias("quota"), (late >= 3).alias("spam"))


@query("fn71_shifted_coordinates", f"WITH {views.GEO} SELECT id, round(lat + 0.1 * cos(radians(k * 3.6)), 6) AS lat, round(lon + 0.1 * sin(radians(k * 3.6)), 6) AS lon FROM geo")
def fn71(spark, d):
    bearing = F.radians(F.col("k") * 3.6)
    return views.geo_events(spark, d).select("id", F.round(F.col("lat") + 0.1 * F.cos(bearing), 6).alias("lat"), F.round(F.col("lon") + 0.1 * F.sin(bearing), 6).alias("lon"))




# ---------------------------------------------------------------- named functions, wrappers and assignment


def split_at_threshold(frame: DataFrame, confidence: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows to use and rows to log for review."""
    sure = F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return frame.where(sure), frame.where(~sure)


@query("u3_abstained_rows", f"WITH {views.LOG} SELECT id, k / 100.0 AS confidence FROM log WHERE k / 100.0 < 0.25")
def u3(spark, d):
    return split_at_threshold(views.review_log(spark, d).select("id", (F.col("k") / 100.0).alias("confidence")), "confidence", 0.25)[1]


def ab_variant(key: Column, share: int = 80) -> Column:
    """U8: A for `share` of a hundred keys, for ever the same."""
    return F.when(F.pmod(F.crc32(key.cast("string")), F.lit(100)) < share, "A").otherwise("B")


@query("u8_ab_assignment")
def u8(spark, d):
    return table(spark, d, "customer").select("c_custkey", ab_variant(F.col("c_custkey")).alias("variant"))
