"""Queries of the training-data operators: each applies one operator, with
production parameters, to its whole table. Collected from the q_ modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODULES = ("crx.llm.q_native", "crx.llm.q_search", "crx.llm.q_text")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(name)
