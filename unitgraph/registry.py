"""All driver queries of the library, by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from .queries import composed, extract, graph, maintenance, search, service, units

    return [graph, units, search, service, maintenance, extract, composed]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        for name, (run, _) in module.QUERIES.items():
            found[name] = run
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        for name, (_, sql) in module.QUERIES.items():
            if sql is not None:
                found[name] = sql
    return found
