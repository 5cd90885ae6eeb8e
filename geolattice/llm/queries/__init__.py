"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm.queries import q01_exact_dedup, q02_secrets, q03_decontaminate, q04_licenses, q05_language_id, q06_quality, q07_toxicity, q08_simhash, q09_packing, q10_katz

MODULES = (q01_exact_dedup, q02_secrets, q03_decontaminate, q04_licenses, q05_language_id, q06_quality, q07_toxicity, q08_simhash, q09_packing, q10_katz)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if m.SQL is not None}
