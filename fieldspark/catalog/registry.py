"""Named queries, their inventory ids and reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_runtime_settings


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable:
    """Register a function under its name; it runs with the library's run-time settings."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"{fn.__name__} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_runtime_settings(spark), sf_dir)

        REGISTRY[fn.__name__] = Query(fn.__name__, tuple(ids.split()), run, sql)
        return fn

    return add
