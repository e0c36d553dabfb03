"""Micro-batches over landed event files: counters, windows, limits, cooldown and bounded memory.

A query here drains a stream over the table to the end, through a sink in the shared folder, and
returns what it wrote. The stream itself is the operator: it takes any streaming DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmesh.catalog import query
from quillmesh.runtime import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """ST1, ST2: a file source with back-pressure; times as timestamps for watermarks."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet")
    parts = f"{sf_dir}/events.parquet"
    rows = source.parquet(parts) if _is_folder(spark, parts) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def drain(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over all that has landed and return the rows that its sink holds; a `base` folder used before goes on where it ended."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.createDataFrame([], stream.schema).schema
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.foreachBatch(_overwrite(f"{base}/out"))
    run = writer.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _overwrite(path: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    return write


def running_counters(stream: DataFrame) -> DataFrame:
    """ST6, A5: counts by type and hour, brought up to date batch by batch."""
    return stream.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("st6_running_counters", "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def st6(spark, d):
    return drain(running_counters(event_stream(spark, d)), "complete")


@query("st1_tumbling_windows", "SELECT date_trunc('day', ts) + INTERVAL 1 DAY * 0 AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def st1(spark, d):
    """Daily windows that the watermark has closed: the last day stays open."""
    windows = event_stream(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    last = table(spark, d, "events").agg(F.date_trunc("day", F.max("ts").cast("timestamp")).alias("last"))
    done = drain(windows, "append").select(F.col("window.start").alias("start"), "event_type", "n")
    return done.crossJoin(F.broadcast(last)).where("start < last").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def rate_limited(stream: DataFrame, client: str, limit: int, window: str = "1 hour") -> DataFrame:
    """ST4: in every fixed window the clients over the limit, and by how many calls."""
    counts = stream.groupBy(client, F.window("ts", window)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(client, F.col("window.start").alias("start"), "n", (F.col("n") - limit).alias("denied"))


@query("st4_rate_limiter", "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, count(*) - 1 AS denied FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def st4(spark, d):
    rows = drain(rate_limited(event_stream(spark, d), "user_id", 1), "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st4b_allowed_calls", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 2")
def st4b(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp"))).orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("event_id")


@query("st2_dedupe_alerts", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) FROM events)")
def st2(spark, d):
    """Alerts once per user, type and day, deduplicated in state."""
    alerts = event_stream(spark, d).withColumn("day", F.date_trunc("day", "ts")).withWatermark("ts", "40 days").dropDuplicates(["user_id", "event_type", "day"])
    return drain(alerts.select("user_id", "event_type", "day")).agg(F.count("*").alias("n"))


def cooled_down(rows: pd.DataFrame, last: float | None, seconds: float, least: float) -> tuple[list[int], float | None]:
    """ST3: event ids to dispatch: at the threshold, and `seconds` after the last one dispatched."""
    out = []
    for at, event, value in sorted(zip(rows["at"], rows["event_id"], rows["value"], strict=True)):
        if value >= least and (last is None or at - last >= seconds):
            out.append(event)
            last = at
    return out, last


def dispatch(stream: DataFrame, seconds: float, least: float) -> DataFrame:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        out, last = cooled_down(rows, state.get[0] if state.exists else None, seconds, least)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "event_id": out}).astype("int64")

    keyed = stream.select("user_id", "event_id", "value", F.unix_micros("ts").cast("double").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)


@query("st3_cooldown_dispatch")
def st3(spark, d):
    return drain(dispatch(event_stream(spark, d), 24 * 3600 * 1e6, 50.0))


def ring_buffer(stream: DataFrame, size: int) -> DataFrame:
    """ST8: after every batch each user's latest `size` events, oldest dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        kept = [*(state.get[0] if state.exists else []), *rows["event_id"].tolist()][-size:]
        state.update((kept,))
        yield pd.DataFrame({"user_id": [key[0]], "events": [kept]})

    keyed = stream.select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, events array<long>", "events array<long>", "update", GroupStateTimeout.NoTimeout)


@query("st8_ring_buffer", "SELECT user_id, list(event_id ORDER BY ts, event_id) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id")
def st8(spark, d):
    rows = drain_latest(ring_buffer(event_stream(spark, d), 5), ["user_id"])
    return rows.select("user_id", "events")


def drain_latest(stream: DataFrame, key: list[str]) -> DataFrame:
    """Run an update stream; of each key the row of the last batch that had it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long")).schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, *[F.col(f"r.{c}") for c in rest if c != "batch"])


@query("st7_sliding_lookback", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def st7(spark, d):
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    return events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st10_threshold_nudges", "SELECT event_type, round(0.5 + 0.05 * (count(*) FILTER (value >= 50) - count(*) FILTER (value < 50)) / count(*), 4) AS threshold FROM events GROUP BY event_type")
def st10(spark, d):
    up = F.count_if(F.col("value") >= 50) - F.count_if(F.col("value") < 50)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(0.5 + 0.05 * up / F.count("*"), 4).alias("threshold"))


@query("st11_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, count(*) AS n, min(event_id) AS first FROM s GROUP BY user_id, session")
def st11(spark, d):
    """An extension: session windows with a gap of six hours."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).select("user_id", "n", "first")
