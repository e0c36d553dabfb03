"""Named queries over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name, with its SQL twin."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return put


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"quillmesh.{name}")


MODULES = ("operators.filters", "operators.aggregates", "operators.joins", "operators.windows", "operators.matching", "operators.ranking", "functions.text", "functions.records", "functions.scoring", "functions.segmentation", "functions.encoding", "operators.generators", "operators.graph", "operators.clusters", "sources.files", "sources.packages", "sources.pdf", "operators.vector_index", "operators.dictionaries", "streaming.events", "streaming.queues", "plans.registry", "plans.refresh")
