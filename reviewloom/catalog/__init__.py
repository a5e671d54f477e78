"""Registered queries over the provided tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from reviewloom.session import configure

_MODULES = (
    "findings", "merging", "timelines", "history", "files", "scans", "requests", "reports", "responses",
    "prompts", "jobs", "streams",
)


def _collect(attribute: str) -> dict:
    entries: dict = {}
    for name in _MODULES:
        entries.update(getattr(import_module(f"reviewloom.catalog.{name}"), attribute))
    return entries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of the session and a folder of parquet tables."""

    def bound(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        return run

    return {name: bound(build) for name, build in _collect("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL with the same columns and rows."""
    return _collect("ORACLES")
