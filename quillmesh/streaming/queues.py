"""Bounded queues and hash-linked ledgers as keyed state that lives on from batch to batch and from run to run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmesh.catalog import query
from quillmesh.operators.windows import verify_chain
from quillmesh.runtime import table
from quillmesh.sources.files import hash_chain
from quillmesh.streaming.events import drain, event_stream

QUEUED = "shard int, event_id long, state string, flush long, at long"


def keyed_state(spark: SparkSession) -> None:
    """State with lists, values and timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BoundedQueue(StatefulProcessor):
    """ST1: records wait in a queue of at most `capacity`; one worker a shard writes them out by `size`, or when the oldest is `age` old.

    The worker rests `pause` after each flush; a record that meets a full queue is dropped. Times are milliseconds of the
    records' own clock, which never goes back, so where records come in order of time the rows don't depend on how they fall into batches.
    Between records the watermark moves the clock, by a timer at the next flush.
    """

    def __init__(self, size: int, capacity: int, age: int, pause: int) -> None:
        self.size, self.capacity, self.age, self.pause = size, capacity, age, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "event_id long, at long")
        self.worker = handle.getValueState("worker", "clock long, free long, flush long")

    def _load(self) -> None:
        self.waiting = [tuple(x) for x in self.queue.get()] if self.queue.exists() else []
        self.clock, self.free, self.flush = self.worker.get() if self.worker.exists() else (0, 0, 0)

    def _due(self) -> int | None:
        """When the worker next writes, as the queue stands."""
        if not self.waiting:
            return None
        full = [self.waiting[self.size - 1][1]] if len(self.waiting) >= self.size else []
        return max(self.free, min([self.waiting[0][1] + self.age, *full]))

    def _written(self, now: int) -> Iterator[tuple]:
        while (at := self._due()) is not None and at <= now:
            self.flush += 1
            self.free = at + self.pause
            yield from ((event, "written", self.flush, at) for event, _ in self.waiting[: self.size])
            del self.waiting[: self.size]

    def _offered(self, records: Iterable[tuple[int, int]]) -> Iterator[tuple]:
        for at, event in records:
            self.clock = max(self.clock, at)
            yield from self._written(self.clock)
            if len(self.waiting) >= self.capacity:
                yield event, "dropped", None, self.clock
            else:
                self.waiting.append((event, self.clock))
                yield from self._written(self.clock)

    def _save(self) -> None:
        if self.waiting:
            self.queue.put(self.waiting)
        else:
            self.queue.clear()
        self.worker.update((self.clock, self.free, self.flush))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (at := self._due()) is not None:
            self.handle.registerTimer(at)

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(out, columns=["event_id", "state", "flush", "at"]).assign(shard=key[0])
        yield frame.astype({"flush": "Int64"})[["shard", "event_id", "state", "flush", "at"]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        records = pd.concat(list(rows))
        out = list(self._offered(sorted(zip(records["at"].tolist(), records["event_id"].tolist(), strict=True))))
        self._save()
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        self.clock = max(self.clock, timerValues.getCurrentWatermarkInMs())
        out = list(self._written(self.clock))
        self._save()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def bounded_queue(stream: DataFrame, shards: int, size: int, capacity: int, age: int, pause: int, delay: str) -> DataFrame:
    """ST1: what becomes of each record of (event_id, ts): written in a flush of its shard, or dropped; records that wait have no row yet.

    Shards are by a hash of the record's id, so that no user, type or time is hot. Records without a time are left out.
    """
    keyed_state(stream.sparkSession)
    rows = stream.where("ts IS NOT NULL").withWatermark("ts", delay).select("ts", "event_id", F.unix_millis("ts").alias("at"), F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(BoundedQueue(size, capacity, age, pause), QUEUED, "Append", "EventTime")


@query("st1b_bounded_queue")
def st1b(spark, d):
    """Every event with its state, those still waiting at the end of the stream included."""
    hour = 3_600_000
    done = drain(bounded_queue(event_stream(spark, d), 16, 50, 1000, 24 * hour, hour, "40 days"))
    return table(spark, d, "events").select("event_id").join(done, "event_id", "left").withColumn("state", F.coalesce("state", F.lit("waiting")))


class Ledger(StatefulProcessor):
    """SRC35: the last block's number and hash of a ledger are its state; what a batch brings is linked on in order of (ts, event_id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, link = self.last.get() if self.last.exists() else (0, "0")
        records = pd.concat(list(rows)).sort_values(["at", "event_id"])
        blocks = hash_chain(enumerate(records["data"], seq + 1), link)
        self.last.update((blocks[-1][0], blocks[-1][3]))
        yield pd.DataFrame(blocks, columns=["seq", "data", "prev_hash", "hash"]).assign(ledger=key[0])[["ledger", "seq", "data", "prev_hash", "hash"]]

    def close(self) -> None:
        pass


def linked_ledgers(stream: DataFrame) -> DataFrame:
    """SRC35: blocks appended to the ledger of each record of (ledger, ts, event_id, data), batch after batch; a missing text is empty."""
    keyed_state(stream.sparkSession)
    rows = stream.select("ledger", "event_id", F.unix_micros("ts").alias("at"), F.coalesce("data", F.lit("")).alias("data"))
    return rows.groupBy("ledger").transformWithStateInPandas(Ledger(), "ledger long, seq long, data string, prev_hash string, hash string", "Append", "None")


@query("src35b_streamed_ledgers", "SELECT user_id AS ledger, count(*) AS blocks, count(*) AS last, true AS good FROM events GROUP BY user_id")
def src35b(spark, d):
    blocks = drain(linked_ledgers(event_stream(spark, d).select(F.col("user_id").alias("ledger"), "ts", "event_id", F.col("props").alias("data"))))
    good = verify_chain(blocks)
    return good.groupBy("ledger").agg(F.count("*").alias("blocks"), F.max("seq").alias("last"), F.bool_and("good").alias("good"))
