"""All registered queries with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorebase.session import ship_package

_PARTS = ("retrieval", "text", "incremental", "state", "summary", "web", "control")


def _entries() -> dict[str, tuple[Callable, str | None]]:
    found: dict[str, tuple[Callable, str | None]] = {}
    for part in _PARTS:
        found.update(importlib.import_module(f"lorebase.plans.catalog_{part}").QUERIES)
    return found


def _runnable(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder.rstrip("/"))

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runnable(query) for name, (query, _) in _entries().items()}


def checks() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
