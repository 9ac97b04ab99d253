"""Profiles, contrasts and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.enrich import joined_null_safe
from folioscope.operators.ranking import quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent): nulls count as a value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("__t"), 2).alias("percent"))


def domain_distribution(df: DataFrame, column: str, low: int = 1, high: int = 5, by: list[str] | None = None) -> DataFrame:
    """(by…, label, share): the share of each label of the fixed domain, 0 where it does not occur."""
    by = by or []
    sums = df.groupBy(*by).agg(*[F.count_if(F.col(column) == k).alias(f"__{k}") for k in range(low, high + 1)], F.count(column).alias("__n"))
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col(f"__{k}") / F.nullif("__n", F.lit(0))).alias("share")) for k in range(low, high + 1)]))
    return sums.select(*by, entries.alias("e")).select(*by, "e.label", F.coalesce("e.share", F.lit(0.0)).alias("share"))


def distribution_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(l1): sum of absolute differences of two distributions over one domain."""
    return a.join(b.withColumnRenamed("share", "__b"), "label", "full").agg(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)))).alias("l1"))


def group_stats(df: DataFrame, keys: list[str], value: str, keep_null_keys: bool = True) -> DataFrame:
    """(keys…, n, mean, median, std) with the sample deviation."""
    rows = df if keep_null_keys else df.dropna(subset=keys)
    stats = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = quantiles(rows, value, {"median": 0.5}, keys)
    return joined_null_safe(stats, middle, keys).select(*keys, "n", "mean", "median", "std")


def group_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys…, n, n_unique, values): the distinct values as one sorted string."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_unique"), F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), ",").alias("values"))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, blank, percent): one pass over the table."""
    sums = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(columns)], *[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"__b{i}") for i, c in enumerate(columns)])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("missing"), F.col(f"__b{i}").alias("blank"), F.round(100 * F.col(f"__b{i}") / F.col("__n"), 2).alias("percent")) for i, c in enumerate(columns)]))
    return sums.select(entries.alias("e")).select("e.*")


def contrast(df: DataFrame, flags: dict[str, Column], value: str, by: list[str] | None = None, share_of: tuple[int, ...] = (5, 1)) -> DataFrame:
    """(by…, flag, n_with, n_without, mean_with, mean_without, delta, share_<k>_with…): all flags in one pass."""
    by = by or []
    rows = df.select(*by, value, F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), c.cast("boolean").alias("on")) for n, c in flags.items()])).alias("e")).select(*by, value, "e.flag", "e.on")
    on, off = F.col("on"), ~F.col("on")
    shares = [F.avg(F.when(cond, (F.col(value) == k).cast("int"))).alias(f"share_{k}_{side}") for k in share_of for side, cond in (("with", on), ("without", off))]
    out = rows.groupBy(*by, "flag").agg(F.count_if(on).alias("n_with"), F.count_if(off).alias("n_without"), F.avg(F.when(on, F.col(value))).alias("mean_with"), F.avg(F.when(off, F.col(value))).alias("mean_without"), *shares)
    return out.withColumn("delta", F.col("mean_with") - F.col("mean_without"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, std, min, q25, q50, q75, max)."""
    stats = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = quantiles(df, column, {f"q{p}": p / 100 for p in (25, 50, 75)})
    return stats.crossJoin(F.broadcast(q)).select("n", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bucket, n): rows with edges[i] <= value < edges[i + 1], 0 where none falls."""
    sums = df.agg(*[F.count_if((F.col(column) >= lo) & (F.col(column) < hi)).alias(f"__{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bucket"), F.col(f"__{i}").alias("n")) for i in range(len(edges) - 1)])).alias("e")).select("e.*")


def lift(df: DataFrame, key: str, tokens: Column, label: str, least: int = 6) -> DataFrame:
    """(label, token, n, lift): how much more often a token occurs in the rows of a label than in all rows."""
    base = df.select(key, label, F.array_distinct(tokens).alias("__t"))
    sizes = base.groupBy(label).agg(F.count("*").alias("__size"))
    total = base.agg(F.count("*").alias("__total"))
    each = base.select(label, F.explode("__t").alias("token"))
    per = each.groupBy(label, "token").agg(F.count("*").alias("n"))
    every = per.groupBy("token").agg(F.sum("n").alias("__all"))
    out = per.join(every.filter(F.col("__all") >= least), "token").join(F.broadcast(sizes), label).crossJoin(F.broadcast(total))
    return out.select(F.col(label).alias("label"), "token", "n", (F.col("n") / F.col("__size") - F.col("__all") / F.col("__total")).alias("lift"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """(row, one column per value): counts, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def count_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys…, counts): a map from value to count, as JSON in the order of values."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), "__n")))
    return per.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda e: F.concat(e.k, F.lit(":"), e["__n"].cast("string"))), ",").alias("counts"))
