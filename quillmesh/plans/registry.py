"""The plug-in surface: named operators, results that carry their error, staged pipelines and linking strategies."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.functions.scoring import apply_rules
from quillmesh.operators import views
from quillmesh.runtime import stage, table


@dataclass
class Registry:
    """Named operators in categories."""

    tools: dict[str, tuple[str, str, Callable]] = field(default_factory=dict)

    def register(self, name: str, category: str, about: str = ""):
        def put(function: Callable) -> Callable:
            if name in self.tools:
                raise ValueError(f"{name} is registered already")
            self.tools[name] = (category, about, function)
            return function

        return put

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, (c, _, _) in self.tools.items() if category in (None, c))

    def run(self, name: str, *args, **parameters):
        return execute(self.tools[name][2], *args, **parameters)


@dataclass
class Result:
    """What an operator returned, or why not, and how long it took."""

    value: object = None
    error: str | None = None
    seconds: float = 0.0


def execute(function: Callable, *args, **parameters) -> Result:
    began = time.monotonic()
    try:
        value = function(*args, **parameters)
        return Result(value, None, time.monotonic() - began)
    except Exception as error:  # noqa: BLE001  the wrapper's contract: any failure is a result
        return Result(None, f"{type(error).__name__}: {error}", time.monotonic() - began)


@dataclass(frozen=True)
class LinkStrategy:
    """A join strategy as parameters: ordered methods, the least confidence, the most links of a node, a boost."""

    methods: tuple[str, ...]
    threshold: float
    most_links: int
    boost: float = 1.0


@dataclass
class Pipeline:
    """U7, SRC36: functions with dependencies, run in their order; each result is staged, so a lost executor costs one stage."""

    tasks: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, function: Callable, after: tuple[str, ...] = ()) -> Pipeline:
        self.tasks[name] = (function, after)
        return self

    def order(self) -> list[str]:
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise ValueError(f"tasks depend on each other: {name}")
            if name not in state:
                state[name] = 1
                for other in self.tasks[name][1]:
                    visit(other)
                state[name] = 2
                out.append(name)

        for name in self.tasks:
            visit(name)
        return out

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name in self.order():
            function, after = self.tasks[name]
            done[name] = stage(function(spark, *[done[a] for a in after]), name)
        return done


@query("u1_registered_tools", "SELECT * FROM (VALUES ('count', 2), ('total', 1)) t(tool, rank)")
def u1(spark, d):
    tools = Registry()
    tools.register("total", "numbers")(lambda f: f.agg(F.sum("n_nationkey")))
    tools.register("count", "numbers")(lambda f: f.agg(F.count("*")))
    found = [tools.run(name, table(spark, d, "nation")) for name in tools.names("numbers")]
    return spark.createDataFrame([(n, k) for n, k, r in zip(tools.names(), (2, 1), found, strict=True) if r.error is None], "tool string, rank int")


@query("u6_rules_as_data", f"WITH {views.LOG} SELECT id, CASE WHEN expert AND k < 50 THEN 'escalate' WHEN gap > 100 THEN 'review' ELSE 'pass' END AS action FROM log")
def u6(spark, d):
    rules = [(1, "gap > 100", "review"), (2, "expert AND k < 50", "escalate")]
    return apply_rules(views.review_log(spark, d), rules, "pass", "action").select("id", "action")


@query("u7_task_order", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars > 100 GROUP BY lang")
def u7(spark, d):
    pipeline = (
        Pipeline()
        .add("report", lambda s, f: f.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")), ("filtered",))
        .add("filtered", lambda s, f: f.where("n_chars > 100"), ("loaded",))
        .add("loaded", lambda s: table(s, d, "documents", "doc_id", "lang", "n_chars"))
    )
    return pipeline.run(spark)["report"]
