"""Registry of end-to-end queries over the driver tables.

Each entry pairs a Spark plan `(spark, sf_dir) -> DataFrame` with an optional
DuckDB oracle (SQL over the same parquet views). Oracles compute expected rows
independently (fixture CTEs + plain SQL), never by calling the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crx.sources.fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_fixtures(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    import pkgutil

    import crx.plans as plans_pkg
    for mod in pkgutil.iter_modules(plans_pkg.__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"crx.plans.{mod.name}")
