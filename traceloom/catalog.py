"""Queries over the driver's tables, one for each operator, with SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.plans import catalog_coupling, catalog_model, catalog_prepare, catalog_recipe, catalog_signal, catalog_table

MODULES = (catalog_signal, catalog_coupling, catalog_table, catalog_model, catalog_prepare, catalog_recipe)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band power in decibels over the baseline, by channels and all."""
    return catalog_signal.QUERIES["band_power_db"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
