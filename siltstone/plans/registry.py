"""All registered queries of the retrieval engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from siltstone.runtime import small_batches, sound_unions

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("texts", "evaluation", "statistics", "runs", "contexts", "stores", "studies", "assessment", "reviews")


def _plans():
    return [import_module(f"siltstone.plans.{name}") for name in MODULES]


def _sound(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sound_unions(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _sound(f) for plan in _plans() for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _plans() for name, sql in plan.SQL.items()}
