"""Short forms for queries that project columns of one table, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from folioscope.sources.tables import table


def projection(source: str, keys: tuple[str, ...], columns: Callable[[], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of ``keys`` and computed columns of a table; only the columns in use reach the scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(*keys, *[c.alias(n) for n, c in columns().items()])

    return run
