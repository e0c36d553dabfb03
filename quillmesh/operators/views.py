"""Domain-shaped views of the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.runtime import table

#: `events` as a log of review records.
LOG = """log AS (
  SELECT *, CASE WHEN k < 10 THEN 'critical' WHEN k < 30 THEN 'high' WHEN k < 60 THEN 'medium' ELSE 'low' END AS severity,
         CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'auto_resolved' ELSE 'manual_resolved' END AS status, k % 5 = 0 AS expert
  FROM (SELECT event_id AS id, ts, CAST(ts AS DATE) AS day, event_type AS type, 'm' || CAST(user_id % 7 AS VARCHAR) AS module,
               's' || CAST(user_id % 3 AS VARCHAR) AS stage, user_id AS document, value AS gap, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.to_date("ts").alias("day"), F.col("event_type").alias("type"),
        F.concat(F.lit("m"), F.col("user_id") % 7).alias("module"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("stage"),
        F.col("user_id").alias("document"), F.col("value").alias("gap"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    severity = F.when(F.col("k") < 10, "critical").when(F.col("k") < 30, "high").when(F.col("k") < 60, "medium").otherwise("low")
    status = F.element_at(F.array(*map(F.lit, ("pending", "in_review", "auto_resolved", "manual_resolved"))), F.col("k") % 4 + 1)
    return log.withColumns({"severity": severity, "status": status, "expert": F.col("k") % 5 == 0})


#: `orders` as court cases.
CASES = """cases AS (
  SELECT o_orderkey AS case_id, o_custkey AS party, o_orderpriority AS category, CAST(o_orderdate AS DATE) AS day, o_totalprice AS penalty,
         CASE o_orderstatus WHEN 'F' THEN 'guilty' WHEN 'P' THEN 'acquitted' ELSE 'pending' END AS verdict, o_custkey % 25 AS place, o_orderkey % 3 = 0 AS night
  FROM orders)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("party"), F.col("o_orderpriority").alias("category"),
        F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("penalty"),
        F.when(F.col("o_orderstatus") == "F", "guilty").when(F.col("o_orderstatus") == "P", "acquitted").otherwise("pending").alias("verdict"),
        (F.col("o_custkey") % 25).alias("place"), (F.col("o_orderkey") % 3 == 0).alias("night"),
    )


#: `events` as located events; degrees by arithmetic on the id.
GEO = """geo AS (
  SELECT event_id AS id, ts, event_type AS type, value AS confidence, user_id AS source,
         30 + (event_id * 37 % 1000) / 500.0 AS lat, 70 + (event_id * 91 % 1000) / 500.0 AS lon, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), F.col("value").alias("confidence"), F.col("user_id").alias("source"),
        (F.lit(30.0) + F.col("event_id") * 37 % 1000 / F.lit(500.0)).alias("lat"), (F.lit(70.0) + F.col("event_id") * 91 % 1000 / F.lit(500.0)).alias("lon"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: `lineitem` as amendments of sections.
VERSIONS = """versions AS (
  SELECT l_partkey % 200 AS section, CAST(l_shipdate AS DATE) AS effective, l_orderkey AS law, l_linenumber AS line,
         CASE l_returnflag WHEN 'R' THEN 'repealed' WHEN 'A' THEN 'amended' ELSE 'inserted' END AS action FROM lineitem)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 200).alias("section"), F.to_date("l_shipdate").alias("effective"), F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "repealed").when(F.col("l_returnflag") == "A", "amended").otherwise("inserted").alias("action"),
    )


#: Places of customers in nations and regions, as a graph of nodes and edges.
NODES = """nodes AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node_id, 'Region' AS label, r_name AS name FROM region UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'Nation', n_name FROM nation UNION ALL
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'Customer', c_name FROM customer UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), 'Supplier', s_name FROM supplier)"""
EDGES = """edges AS (
  SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS src, 'r' || CAST(n_regionkey AS VARCHAR) AS dst, 'PART_OF' AS type FROM nation UNION ALL
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), 'LIVES_IN' FROM customer UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), 'LIVES_IN' FROM supplier)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("region", "r", "r_regionkey", "Region", "r_name"), ("nation", "n", "n_nationkey", "Nation", "n_name"), ("customer", "c", "c_custkey", "Customer", "c_name"), ("supplier", "s", "s_suppkey", "Supplier", "s_name"))
    out = None
    for name, prefix, key, label, text in parts:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key)).alias("node_id"), F.lit(label).alias("label"), F.col(text).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF"), ("customer", "c", "c_custkey", "n", "c_nationkey", "LIVES_IN"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "LIVES_IN"))
    out = None
    for name, p, key, q, to, kind in parts:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(p), F.col(key)).alias("src"), F.concat(F.lit(q), F.col(to)).alias("dst"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out
