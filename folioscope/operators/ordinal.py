"""Ordinal scores: threshold sets, histogram search, blends, stackers and candidate gates."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.metrics import scored


def score_histogram(df: DataFrame, score: str, label: str, bins: int = 400, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(bin, label, n): scores in equal bins. At most bins times labels rows, whatever the size of the table."""
    at = F.least(F.floor((F.col(score) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def search_cuts(histogram: DataFrame, bins: int = 400, low: float = 1.0, high: float = 5.0, drift: float = 0.0, gap: float = 0.03) -> list[float]:
    """Four cut points that maximise kappa less ``drift`` times the L1 distance from the label distribution.

    Coordinate ascent over bin edges on prefix sums of the histogram, which is bounded; no row is read again.
    """
    table = np.zeros((bins, 5))
    for r in histogram.toLocalIterator():
        table[r["bin"], r["label"] - 1] += r["n"]
    total, cum = table.sum(), np.concatenate((np.zeros((1, 5)), np.cumsum(table, axis=0)))
    y, weights = np.arange(1, 6), table.sum(axis=0)
    step = (high - low) / bins

    def value(cuts: list[int]) -> float:
        edges = [0, *cuts, bins]
        cells = np.stack([cum[b] - cum[a] for a, b in itertools.pairwise(edges)])  # predicted by label
        called = cells.sum(axis=1)
        top = (cells * (np.arange(1, 6)[:, None] - y[None, :]) ** 2).sum() / total
        mean_y, mean_p = (weights * y).sum() / total, (called * y).sum() / total
        bottom = (weights * y**2).sum() / total - mean_y**2 + (called * y**2).sum() / total - mean_p**2 + (mean_y - mean_p) ** 2
        return (1 - top / bottom if bottom else 0.0) - drift * np.abs(called / total - weights / total).sum()

    cuts = [int(bins * q) for q in (0.2, 0.4, 0.55, 0.75)]
    least = max(1, round(gap / step))
    for _ in range(20):
        before = list(cuts)
        for i in range(4):
            lo = cuts[i - 1] + least if i else 1
            hi = cuts[i + 1] - least if i < 3 else bins - 1
            cuts[i] = max(range(lo, hi + 1), key=lambda c: (value([*cuts[:i], c, *cuts[i + 1 :]]), -c), default=cuts[i])
        if cuts == before:
            break
    return [low + c * step for c in cuts]


def evaluate_cut_sets(df: DataFrame, score: str, label: str, sets: DataFrame) -> DataFrame:
    """(name, qwk, accuracy, mae, adjacent) of each set of cut points; ``sets`` has name and cuts and is a short list."""
    pred = F.aggregate("cuts", F.lit(1), lambda a, c: a + (F.col(score) >= c).cast("int"))
    rows = df.select(score, label).crossJoin(F.broadcast(sets)).withColumn("__p", pred)
    return rows.groupBy("name").agg(*scored(label, "__p"))


def blend(weights: dict[str, float]) -> Column:
    """Weighted sum of score columns."""
    out = F.lit(0.0)
    for column, weight in weights.items():
        out = out + F.lit(float(weight)) * F.col(column)
    return out


def weight_grid(names: list[str], step: int = 4) -> list[dict[str, float]]:
    """Convex weights in steps of 1 / ``step``, without repeats."""
    out = []
    for parts in itertools.product(range(step + 1), repeat=len(names)):
        if sum(parts) == step:
            out.append({n: p / step for n, p in zip(names, parts)})
    return out


def gram(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products of features with each other and with the target, one aggregation."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    row = df.agg(*cells, *[F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(features)], F.count("*").alias("n")).first()
    k = len(features)
    matrix = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return matrix, np.array([row[f"y{i}"] for i in range(k)], float), row["n"]


def convex_weights(df: DataFrame, features: list[str], target: str, steps: int = 5000) -> dict[str, float]:
    """Weights of least squared error, none negative, of sum one: projected gradient on the Gram matrix."""
    a, b, n = gram(df, features, target)
    w = np.full(len(features), 1 / len(features))
    rate = 1 / max(np.linalg.eigvalsh(a / n)[-1], 1e-9)
    for _ in range(steps):
        v = w - rate * (a @ w - b) / n
        u = np.sort(v)[::-1]
        theta = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
        w = np.maximum(v - theta[np.flatnonzero(u > theta)[-1]], 0)
    return dict(zip(features, w.tolist()))


def ridge_weights(df: DataFrame, features: list[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ridge regression with a free intercept, from one aggregation."""
    means = df.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first()
    centred = df.select(*[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in [*features, target]])
    a, b, _ = gram(centred, features, target)
    w = np.linalg.solve(a + alpha * np.eye(len(features)), b)
    return w, float(means[target]) - float(w @ np.array([means[c] for c in features]))


def aligned(df: DataFrame, score: str, base: str) -> DataFrame:
    """``df`` with ``aligned``: the score with mean and deviation of the base; a constant score becomes the base's mean."""
    stats = df.agg(F.avg(score).alias("__m"), F.stddev_pop(score).alias("__s"), F.avg(base).alias("__bm"), F.stddev_pop(base).alias("__bs"))
    return df.crossJoin(F.broadcast(stats)).withColumn("aligned", F.when(F.col("__s") == 0, F.col("__bm")).otherwise((F.col(score) - F.col("__m")) / F.col("__s") * F.col("__bs") + F.col("__bm"))).drop("__m", "__s", "__bm", "__bs")
