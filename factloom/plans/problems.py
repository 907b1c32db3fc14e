"""Queries of the general operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import units
from ..session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.normalize_quantities(table(spark, sf_dir, "canonical_facts"), table(spark, sf_dir, "structured_tables"), table(spark, sf_dir, "unit_rates"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
