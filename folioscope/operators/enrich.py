"""Joining enrichment sources: caches, priorities, gaps and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ranking import keep_last


def upsert(cache: DataFrame, rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """The cache with new rows, the last of each key kept."""
    return keep_last(cache.unionByName(rows, allowMissingColumns=True), keys, sequence)


def remaining(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that the cache has not seen."""
    return wanted.select(*keys).distinct().join(cache.select(*keys).distinct(), keys, "left_anti")


def redo(wanted: DataFrame, cache: DataFrame, key: str, good: Column) -> DataFrame:
    """Keys without a good row in the cache."""
    return wanted.select(key).distinct().join(cache.filter(good).select(key).distinct(), key, "left_anti")


def found_first(sources: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(value, source) of the first source whose flag says found, null values included; null and "none" where none is."""
    value, name = F.lit(None), F.lit("none")
    for label, flag, column in reversed(sources):
        on = F.coalesce(flag, F.lit(False))
        value, name = F.when(on, column).otherwise(value), F.when(on, F.lit(label)).otherwise(name)
    return value, name


def first_filled(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source) of the first column that is not null and not blank."""
    return found_first([(label, F.trim(column) != "", column) for label, column in sources])


def stacked(parts: dict[str, DataFrame], tag: str = "source_split") -> DataFrame:
    """The tables below each other with the name of each as a tag; columns that one lacks are null."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def prefixed_columns(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """All columns but the keys with a prefix."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def joined_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys match null keys."""
    names = {k: f"__{k}" for k in keys}
    other = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k, n in names.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, match, how).drop(*names.values())


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``df`` with the mapped value of its key, or the default."""
    return df.join(mapping.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))
