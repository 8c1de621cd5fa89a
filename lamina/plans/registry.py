"""All queries of the library proper, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import flattening, geometry, points, residuals, scalars, sections, solvers, stores, surfaces, volumes, wraps
from lamina.session import shuffled_joins

ALL = volumes.QUERIES | surfaces.QUERIES | points.QUERIES | geometry.QUERIES | solvers.QUERIES | stores.QUERIES | residuals.QUERIES | flattening.QUERIES | wraps.QUERIES | sections.QUERIES | scalars.QUERIES


def _run(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled_joins(spark)
    return query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, query) for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
