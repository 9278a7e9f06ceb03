"""Name -> (Spark builder, DuckDB oracle SQL) registry behind ``__spark_entry__``.

Builders take ``(spark, sf_dir)`` and return a DataFrame.  Oracle SQL runs in
DuckDB over views named like the driver tables.  Entries without SQL are
checked on row counts only (model fits, streaming).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    section: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, section: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, section)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # import for side effects (registration)
    from . import catalog_basic, catalog_stats, catalog_ml, catalog_models  # noqa: F401
    return REGISTRY
