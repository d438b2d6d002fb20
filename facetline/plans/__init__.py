"""Registered queries over the driver tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from facetline.plans import callgraph, diffs, files, graph, names, parsing, reports, review, scripts

    return [graph, diffs, files, names, callgraph, parsing, reports, review, scripts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
