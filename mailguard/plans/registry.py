"""Named queries: a Spark builder plus (optionally) its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, ops: tuple[str, ...] = ()):
    """Decorator: add ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ops`` lists the SURVEY operator ids the query exercises.
    """
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, tuple(ops))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from mailguard.plans import (  # noqa: F401
        feature_queries,
        profile_queries,
        metric_queries,
        dataset_queries,
        text_queries,
        model_queries,
        stream_queries,
        source_queries,
        url_queries,
        neighbour_queries,
    )
    return REGISTRY
