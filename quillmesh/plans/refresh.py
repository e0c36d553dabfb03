"""Results kept for a while, and reports brought up to date together."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.plans.registry import Result, execute
from quillmesh.runtime import stage, table


@dataclass
class Cache:
    """ST5: values by key with a lifetime in seconds.

    A value younger than its lifetime is returned; past `early` of it, it is fetched anew in the background
    (one fetch a key at a time). An older one is fetched before it is returned; if that fails, the old value
    stays and is returned, and only without one does the error go to the caller. Frames should be staged by
    the fetching function: a lazy plan would be run again by every reader.
    """

    early: float = 0.7
    clock: Callable[[], float] = time.monotonic
    entries: dict[str, tuple[object, float]] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0
    _busy: dict[str, threading.Thread] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def get(self, key: str, fetch: Callable[[], object], seconds: float = 3600.0):
        with self._lock:
            value, at = self.entries.get(key, (None, None))
            age = None if at is None else self.clock() - at
            if age is not None and age < seconds:
                self.hits += 1
                if age > self.early * seconds and key not in self._busy:
                    self._busy[key] = threading.Thread(target=self._refresh, args=(key, fetch), daemon=True)
                    self._busy[key].start()
                return value
            self.misses += 1
        try:
            new = fetch()
        except Exception:
            if age is None:
                raise
            return value
        self._put(key, new)
        return new

    def settle(self) -> None:
        """Wait for the fetches in the background."""
        with self._lock:
            running = list(self._busy.values())
        for thread in running:
            thread.join()

    def _put(self, key: str, value: object) -> None:
        with self._lock:
            self.entries[key] = (value, self.clock())

    def _refresh(self, key: str, fetch: Callable[[], object]) -> None:
        result = execute(fetch)
        if result.error is None:
            self._put(key, result.value)
        with self._lock:
            self._busy.pop(key, None)


@dataclass
class Reports:
    """ST9: named reports made on demand; one that fails carries its error and stops none of the others."""

    makers: dict[str, Callable[[], DataFrame]]
    latest: dict[str, Result] = field(default_factory=dict)
    updated: float | None = None

    def refresh(self) -> dict[str, Result]:
        self.latest = {name: execute(lambda make=make, name=name: stage(make(), name)) for name, make in self.makers.items()}
        self.updated = time.time()
        return self.latest

    def read(self) -> dict[str, Result]:
        return self.latest if self.updated is not None else self.refresh()

    def status(self, spark: SparkSession) -> DataFrame:
        """(report, ok, n_rows): n_rows is null for a report that failed."""
        rows = [(n, r.error is None, r.value.count() if r.error is None else None) for n, r in self.read().items()]
        return spark.createDataFrame(rows, "report string, ok boolean, n_rows long")


@query("st9_refreshed_reports", "SELECT 'busy_hours' AS report, true AS ok, count(DISTINCT hour(ts)) AS n_rows FROM events UNION ALL SELECT 'types', true, count(DISTINCT event_type) FROM events UNION ALL SELECT 'broken', false, NULL")
def st9(spark, d):
    """Three reports over the events, one of which can't be made."""
    events = table(spark, d, "events", "ts", "event_type", "value")
    reports = Reports({
        "busy_hours": lambda: events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")),
        "types": lambda: events.groupBy("event_type").agg(F.avg("value").alias("mean")),
        "broken": lambda: events.select("no_such_column"),
    })
    return reports.status(spark)


@query("st5_cached_report", "SELECT event_type, count(*) AS n, 3 AS reads, 1 AS fetches FROM events GROUP BY event_type")
def st5(spark, d):
    """One report read three times within its lifetime is made once."""
    cache, made = Cache(), []

    def fetch() -> DataFrame:
        made.append(1)
        return stage(table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n")), "cached")

    for _ in range(3):
        frame = cache.get("types", fetch)
    return frame.select("event_type", "n", F.lit(cache.hits + cache.misses).alias("reads"), F.lit(len(made)).alias("fetches"))
