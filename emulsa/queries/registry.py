"""Queries by name, with the SQL that DuckDB can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import frames, points, renders

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [points, frames, renders]


def queries() -> dict[str, Query]:
    return {name: run for m in MODULES for name, (run, _) in m.KEPT.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for m in MODULES for name, (_, oracle) in m.KEPT.items() if oracle}


FLAGSHIP = points.grade_summary
