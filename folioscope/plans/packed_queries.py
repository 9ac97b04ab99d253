"""Query of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.packed import explode_packed
from folioscope.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, author): one row for each person in train.authors."""
    return explode_packed(table(spark, sf_dir, "train", "id", "authors"), "authors", value="author")


QUERIES = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
