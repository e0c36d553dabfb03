"""Readers that keep bad rows apart, writers with manifests and read-back checks, upserts, archives, ledgers and snapshots.

A query here writes a table out in one form to the shared folder, reads it back and returns the
rows, so that its twin is the table itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.filters import flat_properties
from quillmesh.operators.ranking import renumbered, upsert
from quillmesh.runtime import shared_dir, stage, table


def landing(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/landed/{label}-{uuid.uuid4().hex}"


def read_validated(spark: SparkSession, path: str, schema: StructType, required: list[str], multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC1, SRC3: (valid rows, rejected rows) of JSON files; a row that doesn't parse or lacks a required field is rejected, not lost."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("multiLine", multiline).option("recursiveFileLookup", True).json(path)
    rows = stage(rows, "validated")  # the corrupt column can't be asked for alone
    bad = F.col("_corrupt_record").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad)


@query("src1_json_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def src1(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    path = landing(spark, "json")
    orders.write.json(path)
    return read_validated(spark, path, orders.schema, ["o_orderkey"])[0]


@query("src3_rejected_rows", "SELECT count(*) AS n_valid, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS n_rejected FROM orders WHERE o_orderkey % 5 <> 0")
def src3(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    path = landing(spark, "broken")
    whole = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    orders.select(F.when(F.col("o_orderkey") % 10 == 0, F.lit("{torn")).when(F.col("o_orderkey") % 5 == 0, F.lit('{"o_orderstatus":"F"}')).otherwise(whole).alias("value")).write.text(path)
    good, bad = read_validated(spark, path, orders.schema, ["o_orderkey"])
    return good.agg(F.count("*").alias("n_valid")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("n_rejected"))))


@query("src4_upsert_sink", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def src4(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    path = landing(spark, "upsert")
    upsert(old, old.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new")), ["o_orderkey"]).write.parquet(path)
    return spark.read.parquet(path)


def read_any(spark: SparkSession, folder: str) -> DataFrame:
    """SRC2, SRC5: (path, text) of every file of a folder, by suffix: text, CSV and JSON as lines of one text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,csv,json}").load(folder)
    return files.select("path", F.decode("content", "utf-8").alias("text"))


@query("src5_format_dispatch", "SELECT 'csv' AS suffix, count(*) AS n_lines FROM nation UNION ALL SELECT 'txt', count(*) FROM region")
def src5(spark, d):
    path = landing(spark, "mixed")
    table(spark, d, "nation").coalesce(1).write.csv(f"{path}/csv")
    table(spark, d, "region").select("r_name").coalesce(1).write.text(f"{path}/txt")
    lines = read_any(spark, path).select(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("suffix"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line != ''").groupBy("suffix").agg(F.count("*").alias("n_lines"))


@query("src9_landed_csv_with_ids", f"WITH {views.GEO} SELECT md5(CAST(id AS VARCHAR) || '-' || type) AS key, k FROM geo WHERE lat BETWEEN 30.5 AND 31.5")
def src9(spark, d):
    """A landed CSV feed in a bounding box; ids by digest."""
    path = landing(spark, "csv")
    views.geo_events(spark, d).select("id", "type", "lat", "k").write.option("header", True).csv(path)
    rows = spark.read.schema("id long, type string, lat double, k int").option("header", True).csv(path)
    return rows.where(F.col("lat").between(30.5, 31.5)).select(F.md5(F.concat_ws("-", "id", "type")).alias("key"), "k")


@query("src10_one_reading_a_day", "SELECT CAST(ts AS DATE) AS day, arg_min(value, (abs(hour(ts) - 12), event_id)) AS value FROM events GROUP BY 1")
def src10(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min_by("value", F.struct(F.abs(F.hour("ts") - 12).alias("h"), "event_id")).alias("value"))


@query("src11_xml_feed", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def src11(spark, d):
    path = landing(spark, "xml")
    table(spark, d, "nation").coalesce(1).write.option("rowTag", "item").option("rootTag", "feed").xml(path)
    rows = spark.read.option("rowTag", "item").schema("n_nationkey int, n_name string, n_regionkey int").xml(path)
    return rows.where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("src12_simulated_alerts", "SELECT event_id AS alert, CASE WHEN event_id % 10 < 5 THEN 'north' WHEN event_id % 10 < 8 THEN 'centre' ELSE 'south' END AS zone, CAST(ts AS DATE) - CAST(event_id % 30 AS INTEGER) AS day FROM events")
def src12(spark, d):
    """Alerts landed from the table of events, as a feed: zones by weight 5, 3 and 2, days up to 29 before the event's."""
    path = landing(spark, "alerts")
    table(spark, d, "events", "event_id", "ts").select("event_id", F.to_date("ts").alias("day")).write.json(path)
    rows = spark.read.schema("event_id long, day date").json(path)
    zone = F.when(F.col("event_id") % 10 < 5, "north").when(F.col("event_id") % 10 < 8, "centre").otherwise("south")
    return rows.select(F.col("event_id").alias("alert"), zone.alias("zone"), F.date_sub("day", (F.col("event_id") % 30).cast("int")).alias("day"))


@query("src13_column_discovery", "SELECT * FROM (VALUES ('p_partkey', 0), ('p_name', 1), ('p_brand', 2), ('p_type', 3), ('p_size', 4), ('p_retailprice', 5)) t(column_name, position)")
def src13(spark, d):
    """A table's columns from its schema: no row is read."""
    return spark.createDataFrame([(c, k) for k, c in enumerate(table(spark, d, "part").columns)], "column_name string, position int")


@query("src14_vector_table", "SELECT vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings")
def src14(spark, d):
    path = landing(spark, "vectors")
    table(spark, d, "embeddings").write.partitionBy("label").parquet(path)
    return spark.read.parquet(path).select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").alias("dims"))


@query("src15_merged_indexes", "SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS row_id, vec_id FROM (SELECT vec_id, vec_id % 2 AS part FROM embeddings)")
def src15(spark, d):
    """Two indexes of equal dimension one after another; a vector of another length fails the read."""
    e = table(spark, d, "embeddings")
    checked = e.withColumn("dims", F.when(F.size("embedding") == 64, F.size("embedding")).otherwise(F.raise_error(F.lit("dimension differs"))))
    return renumbered([checked.where("vec_id % 2 = 0"), checked.where("vec_id % 2 = 1")], "vec_id").select("row_id", "vec_id")


@query("src17_table_of_records", f"WITH {views.LOG} SELECT stage, count(*) AS n FROM log WHERE day = DATE '2024-01-10' GROUP BY stage")
def src17(spark, d):
    """Records partitioned by day and stage: a filter on them reads those folders only."""
    path = landing(spark, "records")
    views.review_log(spark, d).write.partitionBy("day", "stage").parquet(path)
    return spark.read.parquet(path).where("day = DATE '2024-01-10'").groupBy("stage").agg(F.count("*").alias("n"))


@query("src18_insert_or_replace", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def src18(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id")


@query("src19_daily_files", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def src19(spark, d):
    path = landing(spark, "daily")
    days = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    for part in (0, 1):
        days.where(F.col("event_id") % 2 == part).select("event_id", "day").write.mode("append").partitionBy("day").json(path)
    return spark.read.schema("event_id long, day date").json(path).groupBy("day").agg(F.count("*").alias("n"))


@query("src20_sql_export", f"WITH {views.LOG} SELECT 'INSERT INTO log VALUES (' || CAST(id AS VARCHAR) || ', ''' || type || ''');' AS statement FROM log WHERE severity = 'critical'")
def src20(spark, d):
    path = landing(spark, "sql")
    text = F.format_string("INSERT INTO log VALUES (%d, '%s');", F.col("id"), F.left("type", F.lit(100)))
    views.review_log(spark, d).where("severity = 'critical'").select(text.alias("value")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "statement")


def archive_split(frame: DataFrame, old, keep_status: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC21: (kept, archived) by one predicate, so that a row is in exactly one."""
    gone = old & ~F.col("status").isin(*keep_status)
    return frame.where(~gone), frame.where(gone)


@query("src21_archive_then_delete", f"WITH {views.LOG} SELECT count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS archived FROM (SELECT day < DATE '2024-01-20' AND status NOT IN ('pending', 'in_review') AS gone FROM log)")
def src21(spark, d):
    kept, gone = archive_split(views.review_log(spark, d), F.col("day") < F.lit("2024-01-20").cast("date"), ["pending", "in_review"])
    path = landing(spark, "archive")
    gone.select("id", "type").write.option("compression", "gzip").json(path)
    archived = spark.read.schema("id long, type string").json(path).agg(F.count("*").alias("archived"))
    return kept.agg(F.count("*").alias("kept")).crossJoin(F.broadcast(archived))


@query("src22_profile_export", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def src22(spark, d):
    path = landing(spark, "profiles")
    table(spark, d, "documents", "doc_id", "lang", "n_chars").write.partitionBy("lang").json(path)
    return spark.read.schema("doc_id long, n_chars long, lang string").json(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("src23_graph_export", f"WITH {views.NODES} SELECT node_id, label, name FROM nodes")
def src23(spark, d):
    path = landing(spark, "graph")
    views.nodes(spark, d).dropDuplicates(["node_id"]).orderBy("node_id").write.option("header", True).csv(path)
    return spark.read.schema("node_id string, label string, name string").option("header", True).csv(path)


def export_with_provenance(frame: DataFrame, path: str, required: list[str]) -> DataFrame:
    """SRC26, SRC27: write CSV with complex values as JSON, read it back; a needed field that is missing fails the export."""
    checked = frame
    for c in required:
        checked = checked.withColumn(c, F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "none", "n/a"), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    flat_properties(checked).write.option("header", True).option("escape", '"').csv(path)
    back = frame.sparkSession.read.option("header", True).option("escape", '"').csv(path)
    return back.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in required])


@query("src26_provenance_export", "SELECT count(*) AS n, 0::BIGINT AS no_source, 0::BIGINT AS no_key FROM part")
def src26(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.lit("part.parquet").alias("source"), F.struct("p_brand", "p_size").alias("detail"))
    return export_with_provenance(rows, landing(spark, "provenance"), ["source", "key"])


@query("src28_merge_by_id", "SELECT o_custkey AS node_id, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY o_custkey")
def src28(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n"))


@query("src30_unwound_clauses", "SELECT c_custkey AS chunk, unnest(string_split(c_name, '#')) AS clause FROM customer")
def src30(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("chunk"), F.explode(F.split("c_name", "#")).alias("clause"))


@query("src31_recursive_json", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def src31(spark, d):
    path = landing(spark, "nested")
    table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("data")).write.json(f"{path}/a/b")
    table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name")).write.json(f"{path}/c")
    rows = spark.read.schema("id int, name string, data struct<id:int,name:string>").option("recursiveFileLookup", True).json(path)
    return rows.select(F.coalesce("id", "data.id").alias("id"), F.coalesce("name", "data.name").alias("name")).dropDuplicates(["id"])


@query("src33_drop_nulls_and_stringify", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN '{\"balance\":true,\"nation\":' || s_nationkey || '}' ELSE '{\"nation\":' || s_nationkey || '}' END AS meta FROM supplier")
def src33(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.when(F.col("s_acctbal") > 0, True).alias("balance"), F.col("s_nationkey").alias("nation"))).alias("meta"))


@query("src34_append_records", "SELECT 3 * count(*) AS n FROM region")
def src34(spark, d):
    path = landing(spark, "append")
    for _ in range(3):
        table(spark, d, "region").write.mode("append").json(path)
    return spark.read.schema("r_regionkey int").json(path).agg(F.count("*").alias("n"))


def hash_chain(rows, first: str = "0") -> list[tuple]:
    """SRC35: blocks (seq, data, prev_hash, hash), each linked to the one before. Sequential by nature, so one ledger at a time."""
    import hashlib

    out, link = [], first
    for seq, data in rows:
        own = hashlib.sha256(f"{seq}|{data}|{link}".encode()).hexdigest()
        out.append((seq, data, link, own))
        link = own
    return out


def chained(rows: DataFrame) -> DataFrame:
    """SRC35: (ledger, ts, id, data) as blocks (ledger, seq, data, prev_hash, hash).

    Ledgers are sorted in their partition and linked as the rows go by: a task holds one Arrow batch and one
    hash, however long a ledger is. A ledger stays in one task, as each hash needs the one before. A missing text is empty.
    """
    import pandas as pd

    def link(batches):
        ledger, seq, last = None, 0, "0"
        for batch in batches:
            blocks = []
            for own, part in batch.groupby("ledger", sort=False, dropna=False):
                own = None if pd.isna(own) else own
                if own != ledger or seq == 0:
                    ledger, seq, last = own, 0, "0"
                new = hash_chain(enumerate(part["data"], seq + 1), last)
                seq, last = new[-1][0], new[-1][3]
                blocks += [(own, *block) for block in new]
            yield pd.DataFrame(blocks, columns=["ledger", "seq", "data", "prev_hash", "hash"]).astype({"ledger": "Int64"})

    ordered = rows.select(F.col("ledger").cast("long"), "ts", "id", F.coalesce("data", F.lit("")).alias("data")).repartition("ledger").sortWithinPartitions("ledger", "ts", "id")
    return ordered.mapInPandas(link, "ledger long, seq long, data string, prev_hash string, hash string")


@query("src35_hash_linked_ledgers", "SELECT user_id AS ledger, count(*) AS blocks, true AS good FROM events GROUP BY user_id")
def src35(spark, d):
    from quillmesh.operators.windows import verify_chain

    rows = table(spark, d, "events").select(F.col("user_id").alias("ledger"), "ts", F.col("event_id").alias("id"), F.col("props").alias("data"))
    return verify_chain(chained(rows)).groupBy("ledger").agg(F.count("*").alias("blocks"), F.bool_and("good").alias("good"))


@query("src36_versioned_checkpoint", "SELECT '1.0' AS version, count(*) AS n FROM customer")
def src36(spark, d):
    saved = stage(table(spark, d, "customer", "c_custkey").withColumn("version", F.lit("1.0")), "task")
    return saved.groupBy("version").agg(F.count("*").alias("n"))


@query("src37_conversation_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def src37(spark, d):
    path = landing(spark, "chats")
    chats = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    chats.write.json(path)
    return spark.read.schema(chats.schema).json(path).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("src38_snapshots", "SELECT c_custkey, CAST(2 AS INTEGER) AS version FROM customer")
def src38(spark, d):
    path = landing(spark, "snapshots")
    for version in (1, 2):
        table(spark, d, "customer", "c_custkey").withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("c_custkey").agg(F.max("version").alias("version"))


@query("src39_backfill_metadata", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name, 'unknown') AS title FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 15")
def src39(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation").where("n_nationkey < 15"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), "n_name", F.lit("unknown")).alias("title"))


@query("src16_index_with_registry", "SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label")
def src16(spark, d):
    """An index, its registry and its mapping as three tables, read back and joined."""
    path = landing(spark, "index")
    vectors = table(spark, d, "embeddings")
    vectors.select("vec_id", "embedding").write.parquet(f"{path}/vectors")
    vectors.select("vec_id", "label").write.parquet(f"{path}/mapping")
    vectors.groupBy("label").agg(F.count("*").alias("n")).write.parquet(f"{path}/registry")
    first = spark.read.parquet(f"{path}/mapping").join(spark.read.parquet(f"{path}/vectors").select("vec_id"), "vec_id").groupBy("label").agg(F.min("vec_id").alias("first"))
    return spark.read.parquet(f"{path}/registry").join(first, "label").select("label", "n", "first")


@query("src25_layered_json_recovery", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def src25(spark, d):
    """Direct, fenced, embedded or mended: the first reading that parses."""
    from quillmesh.operators.generators import json_objects, repaired_json

    part = F.col("event_id") % 4
    text = (
        F.when(part == 0, F.col("props")).when(part == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(part == 2, F.concat(F.lit("see "), F.col("props"), F.lit(" there"))).otherwise(F.regexp_replace(F.regexp_replace("props", '"', "'"), "}", ",}"))
    )
    direct = F.get_json_object("text", "$.k")
    fenced = F.get_json_object(F.regexp_extract("text", r"```(?:json)?\s*([\s\S]*?)```", 1), "$.k")
    inner = F.get_json_object(F.get(json_objects(F.col("text")), F.lit(0)), "$.k")
    mended = F.get_json_object(repaired_json(F.col("text")), "$.k")
    return table(spark, d, "events").select("event_id", text.alias("text")).select("event_id", F.coalesce(direct, fenced, inner, mended).cast("int").alias("k"))


@query("src29_grouped_ingest", f"WITH {views.NODES} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def src29(spark, d):
    """Nodes landed as CSV and taken in by label, a folder each; batching is the writer's own."""
    path = landing(spark, "ingest")
    views.nodes(spark, d).write.option("header", True).csv(f"{path}/csv")
    nodes = spark.read.schema("node_id string, label string, name string").option("header", True).csv(f"{path}/csv")
    nodes.write.partitionBy("label").parquet(f"{path}/graph")
    return spark.read.parquet(f"{path}/graph").groupBy("label").agg(F.count("*").alias("n"))
