"""Every query of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under this name."""

    def add(run):
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, sql)
        return run

    return add
