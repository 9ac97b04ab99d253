"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import family_queries, gate_queries, model_queries, ordinal_queries, packed_queries, profile_queries, text_queries

_MODULES = [packed_queries, text_queries, profile_queries, ordinal_queries, model_queries, gate_queries, family_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_queries.QUERIES["g1_g4_gated_candidates"](spark, sf_dir)
