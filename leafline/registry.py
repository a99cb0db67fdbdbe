"""Names of the core queries with their Spark plan and their oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    """A query and, where SQL can express it, its DuckDB text."""

    run: Query
    sql: str | None = None


_REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add the decorated plan under ``name``."""

    def add(run: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = Registered(run, sql)
        return run

    return add


def _loaded() -> dict[str, Registered]:
    from leafline import plans  # noqa: F401  registers on import

    return _REGISTRY


def core_queries() -> dict[str, Query]:
    return {name: found.run for name, found in _loaded().items()}


def core_oracles() -> dict[str, str]:
    return {name: found.sql for name, found in _loaded().items() if found.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the smoke check runs."""
    return _loaded()["table_roundtrip_records"].run(spark, sf_dir)
