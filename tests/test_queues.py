"""Queues and ledgers that live in state, against sequential replays over several batches and runs."""

import datetime
import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillmesh.sources import files
from quillmesh.streaming import events, queues

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "event_id long, user_id long, ts timestamp, props string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")


def replay(records, size, capacity, age, pause, end):
    """One shard, second by second."""
    waiting, out, free, flush = [], {}, 0, 0
    arriving = defaultdict(list)
    for at, event in sorted(records):
        arriving[at].append(event)

    def work(now):
        nonlocal free, flush
        while waiting and now >= free and (len(waiting) >= size or now - waiting[0][0] >= age):
            flush, free = flush + 1, now + pause
            for _, event in waiting[:size]:
                out[event] = ("written", flush, now)
            del waiting[:size]

    for now in range(0, end + 1):
        work(now)
        for event in arriving[now]:
            if len(waiting) >= capacity:
                out[event] = ("dropped", None, now)
            else:
                waiting.append((now, event))
                work(now)
    return out


def test_bounded_queue_equals_its_replay(spark, tmp_path):
    rng = random.Random(8)
    base = int(START.timestamp() * 1000)
    at, records = 0, []
    for k in range(160):
        at += rng.choice([0, 0, 1, 1, 2, 60])
        records.append((k, at))
    for part in range(4):
        own = records[part * 40 : part * 40 + 40]
        land(spark, tmp_path, [(k, 0, START + datetime.timedelta(milliseconds=t), "") for k, t in own])
    land(spark, tmp_path, [(-1, 0, START + datetime.timedelta(days=1), ""), (-2, 0, None, "")])
    rows = events.drain(queues.bounded_queue(stream(spark, tmp_path), 1, 4, 6, 20, 9, "0 seconds"), base=f"{tmp_path}/run").collect()
    got = {r.event_id: (r.state, r.flush, r.at - base) for r in rows}
    expected = replay([(t, k) for k, t in records], 4, 6, 20, 9, at + 10_000)
    assert got == expected and len(rows) == len(got) == 160
    assert {s for s, _, _ in got.values()} == {"written", "dropped"} and any(n < 4 for n in flush_sizes(got).values())


def flush_sizes(rows):
    sizes = defaultdict(int)
    for state, flush, _ in rows.values():
        if state == "written":
            sizes[flush] += 1
    return sizes


def test_every_event_has_a_state(spark, sf_dir):
    rows = queues.st1b(spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count() and rows.where("state = 'written'").count() > 0


def sequential(records):
    blocks, last = {}, defaultdict(lambda: (0, "0"))
    for ledger, data in records:
        seq, link = last[ledger]
        own = hashlib.sha256(f"{seq + 1}|{data}|{link}".encode()).hexdigest()
        blocks[ledger, seq + 1] = (data, link, own)
        last[ledger] = (seq + 1, own)
    return blocks


def test_ledgers_go_on_over_two_runs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, 3]), START + datetime.timedelta(seconds=k // 2), f"d{k}" if k % 7 else None) for k in range(90)]
    expected = sequential([(r[1], r[3] or "") for r in rows])
    named = lambda: queues.linked_ledgers(stream(spark, tmp_path).select(F.col("user_id").alias("ledger"), "ts", "event_id", F.col("props").alias("data")))
    for part in (rows[:30], rows[30:60]):
        land(spark, tmp_path, part)
    events.drain(named(), base=f"{tmp_path}/run")
    land(spark, tmp_path, rows[60:])
    blocks = events.drain(named(), base=f"{tmp_path}/run").collect()
    assert {(b.ledger, b.seq): (b.data, b.prev_hash, b.hash) for b in blocks} == expected and len(blocks) == 90


def test_chained_in_small_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), k // 2, k, f"d{k}" if k % 5 else None) for k in range(120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        blocks = files.chained(spark.createDataFrame(rows, "ledger long, ts long, id long, data string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(b.ledger, b.seq): (b.data, b.prev_hash, b.hash) for b in blocks} == sequential([(r[0], r[3] or "") for r in rows])
