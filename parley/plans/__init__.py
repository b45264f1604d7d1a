"""Queries that bind the operators to the driver's tables, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its own name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    from importlib import import_module

    for module in ("dashboard", "tasks", "people", "retrieval", "voices", "timeline", "quality", "live", "editing", "scalars", "documents", "stores", "answers", "sound"):
        import_module(f"parley.plans.{module}")
