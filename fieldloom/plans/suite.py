"""The query suite of the extraction engine: name to (spark, sf_dir) -> DataFrame, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import diff_suite, heal_suite, html_suite, repair_suite, stats_suite, values_suite

MODULES = (html_suite, values_suite, stats_suite, repair_suite, diff_suite, heal_suite)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
