"""Query registry: name -> (Spark builder, oracle SQL or None).

Query names follow ``<operator id>_<name>`` (SURVEY §2).  Each builder takes
``(spark, sf_dir)`` and returns a lazy DataFrame over the driver tables; the
SQL (when given) computes the same rows in DuckDB from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its oracle ``sql`` (None: rows-only check)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    """``WITH a AS (...), b AS (...)`` from CTE bodies (each ``name AS (...)``)."""
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n"


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (annotations, comparisons, dialogs, io, judged, logs, misc, ratings,  # noqa: F401
                   scored, streams, vectors)
