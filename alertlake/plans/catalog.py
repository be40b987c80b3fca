"""Registry of named queries: a Spark builder each and, where SQL can say the same, the SQL to check it against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, sql)
        return build
    return add


MODULES = ("cleaning_queries", "detector_queries", "pattern_queries", "trend_queries", "alert_queries",
           "source_queries", "retrieval_queries", "drift_queries",
           "version_queries", "stream_queries")


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"alertlake.plans.{module}")
    return CATALOG
