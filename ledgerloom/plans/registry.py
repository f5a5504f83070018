"""All queries and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bookkeeping, changes, controls, costs, duplicates, forecasts, functions, ledger, listings, mappings, methods, models, phases, positions, registers, schedules, streams, sweeps, trees

MODULES = (costs, duplicates, forecasts, schedules, mappings, functions, streams, ledger, controls, phases, bookkeeping, registers, models, sweeps, trees, methods, listings, changes, positions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
