"""Ranks that do not gather a large group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def hashed_rank(df: DataFrame, group: list[str], digest: Column, out: str = "rank") -> DataFrame:
    """``df`` with the position from 1 of each row in the order of a hexadecimal digest inside its group.

    The digest's first three digits cut each group into 4096 slots; positions inside a slot are added to the counts
    of the slots before it, so a group of any size is ranked by many tasks. Same result as a plain row_number.
    """
    rows = df.withColumn("__d", digest).withColumn("__slot", F.substring("__d", 1, 3))
    counts = rows.groupBy(*group, "__slot").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__slot").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    match = F.col("__slot") == F.col("__s")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "__slot").orderBy("__d"))
    return rows.join(bases, match).withColumn(out, (F.col("__base") + inside).cast("int")).select(*df.columns, out)


def ranked_values(df: DataFrame, value: str, group: list[str], slots: int = 64) -> DataFrame:
    """(group…, value, __n, __below, __all): each distinct value of a group with its count, the rows below it and all rows.

    Approximate quantiles cut each group into slots; counts of the slots before it are added to the counts inside a
    slot, so a group of any size is ranked by many tasks. Nulls are left out.
    """
    names = [f"__g{i}" for i in range(len(group))]
    keyed = df.filter(F.col(value).isNotNull()).select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(value).alias("__v"))
    edges = F.percentile_approx("__v", [i / slots for i in range(1, slots)], 1000).alias("__edges")
    counts = keyed.groupBy(*names, "__v").agg(F.count("*").alias("__n"))
    cuts = keyed.groupBy(*[F.col(n).alias(f"{n}c") for n in names]).agg(edges)
    placed = counts.join(cuts, _same(names, [f"{n}c" for n in names]), "left").withColumn("__slot", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).select(*names, "__v", "__n", "__slot")
    per = placed.groupBy(*names, "__slot").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(*names).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("__slot").alias("__s"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"), F.sum("__t").over(Window.partitionBy(*names)).alias("__all"))
    inside = Window.partitionBy(*names, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(bases, _same(names, [f"{n}b" for n in names]) & (F.col("__slot") == F.col("__s")))
    below = F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    return ranked.select(*[F.col(n).alias(g) for g, n in zip(group, names)], F.col("__v").alias(value), "__n", below.alias("__below"), "__all")


def _same(left: list[str], right: list[str]) -> Column:
    """All columns equal, nulls too."""
    match = F.lit(True)
    for x, y in zip(left, right):
        match = match & F.col(x).eqNullSafe(F.col(y))
    return match


def percentile_rank(df: DataFrame, value: str, group: list[str], out: str, least: int = 0) -> DataFrame:
    """``df`` with the average rank of ``value`` inside its group over the number of values; null stays null, and is given where the group has fewer than ``least`` values."""
    return _back(df, _shares(df, value, group, out, least), [*group, value], out)


def _shares(df: DataFrame, value: str, group: list[str], out: str, least: int) -> DataFrame:
    share = (F.col("__below") + (F.col("__n") + 1) / 2) / F.col("__all")
    return ranked_values(df, value, group).withColumn(out, F.when(F.col("__all") >= least, share))


def global_percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """As ``percentile_rank`` over the whole table."""
    return percentile_rank(df, value, [], out)


def rank_with_fallback(df: DataFrame, value: str, groups: list[list[str]], out: str, least: int = 5) -> DataFrame:
    """``df`` with the percentile rank of ``value`` in the first of the ``groups`` of columns in which its group has ``least`` values, else in the whole table."""
    seen = df
    for i, group in enumerate([*groups, []]):
        seen = _back(seen, _shares(df, value, group, f"__r{i}", least if group else 0), [*group, value], f"__r{i}")
    ranks = [f"__r{i}" for i in range(len(groups) + 1)]
    return seen.withColumn(out, F.coalesce(*ranks)).drop(*ranks)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """(group…, one column per name of ``shares``): exact quantiles, interpolated between neighbours, from ranks in two levels."""
    ranked = ranked_values(df, value, group or [])
    columns = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__all") - 1)
        pick = lambda i: F.max(F.when((F.col("__below") <= i) & (i < F.col("__below") + F.col("__n")), F.col(value).cast("double")))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        columns.append((low + (high - low) * (F.max(at) - F.max(F.floor(at)))).alias(name))
    return ranked.groupBy(*(group or [])).agg(*columns)


def report_position(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """``df`` with the position from 1 of each row in the order of the whole table: ranges of the order, counts before a range, positions inside it."""
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    bases = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return placed.join(bases, F.col("__p") == F.col("__q")).withColumn(out, (F.col("__base") + inside).cast("int")).select(*df.columns, out)


def _back(df: DataFrame, ranked: DataFrame, keys: list[str], out: str) -> DataFrame:
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    small = ranked.select(*[F.col(k).alias(n) for k, n in names.items()], out)
    match = _same(list(names), list(names.values()))
    return df.join(small, match, "left").drop(*names.values())


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark drops later rows before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def keep_last(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """One row per key, the one of the largest sequence, by a partial aggregate and no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*sequence, F.struct(*[F.col(c) for c in rest]).alias("__row"))).alias("__best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"__best.__row.{c}").alias(c) for c in rest]).select(*df.columns)
