"""The list of named queries: what runs, what it covers, and its SQL answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with the inventory rows it covers."""

    def register(fn: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, covers, fn, sql)
        return fn

    return register
