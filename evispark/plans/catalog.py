"""The registered queries, collected from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evispark.plans import registry, training

MODULES = ("fields", "selecting", "measuring", "modelling", "remaining", "evidence", "stores")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in MODULES:
        importlib.import_module(f"evispark.plans.{m}")
    return {**registry.QUERIES, **training.QUERIES}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p6_found"](spark, sf_dir)
