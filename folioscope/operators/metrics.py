"""Agreement metrics of ordinal labels, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qwk(y: str, p: str) -> Column:
    """Quadratic weighted kappa in closed form; null where neither side varies and they agree."""
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    bottom = F.var_pop(yy) + F.var_pop(pp) + F.pow(F.avg(yy) - F.avg(pp), F.lit(2.0))
    return 1 - F.try_divide(F.avg((yy - pp) * (yy - pp)), bottom)


def accuracy(y: str, p: str) -> Column:
    """Share of equal labels."""
    return F.avg((F.col(y) == F.col(p)).cast("int"))


def mae(y: str, p: str) -> Column:
    """Mean absolute difference."""
    return F.avg(F.abs(F.col(y) - F.col(p)))


def adjacent_accuracy(y: str, p: str) -> Column:
    """Share of labels at most one apart."""
    return F.avg((F.abs(F.col(y) - F.col(p)) <= 1).cast("int"))


def macro_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """(macro_f1): mean F1 over the labels seen on either side, 0 where undefined."""
    both = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    sides = both.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("fn"), F.lit(0).cast("long").alias("fp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.col("n").alias("fp")))).alias("e")).select("e.*")
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("actual"), F.sum("fp").alias("called"))
    return per.agg(F.avg(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("called")), F.lit(0.0))).alias("macro_f1"))


def label_by_cuts(score: Column | str, cuts: list[float], low: int = 1) -> Column:
    """``low`` plus the number of cut points at or below the score; null stays null."""
    s = F.col(score) if isinstance(score, str) else score
    return sum(((s >= F.lit(float(c))).cast("int") for c in cuts), F.lit(low))


def scored(y: str, p: str) -> list[Column]:
    """The metrics of one prediction, rounded."""
    return [F.round(qwk(y, p), 6).alias("qwk"), F.round(accuracy(y, p), 6).alias("accuracy"), F.round(mae(y, p), 6).alias("mae"), F.round(adjacent_accuracy(y, p), 6).alias("adjacent")]
