"""All registered queries of the engine, with the DuckDB SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolattice.plans import building, cameras, localization, retrieval, solving

MODULES = (retrieval, cameras, localization, building, solving)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for m in MODULES for name, build in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
