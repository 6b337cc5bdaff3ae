"""Registered queries: one Spark callable per operator, with its DuckDB oracle.

Each module registers ``(spark, sf_dir) -> DataFrame`` callables under the
in SQL, the equivalent SQL text that DuckDB runs over the same parquet files.
"""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
_MODULES = ["suite.joblog", "suite.repair", "suite.merge", "suite.quality", "suite.drift",
            "suite.names", "suite.requests", "suite.loading", "suite.scalars", "suite.schema",
            "suite.ingest"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
