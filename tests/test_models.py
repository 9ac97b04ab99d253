"""Models: ridge against its closed form, and out-of-fold scores that cover each row once."""

from __future__ import annotations

import numpy as np
import pytest

from folioscope.operators import models
from folioscope.plans.base import with_folds


def test_ridge_and_folds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = np.clip(np.round(3 + x[:, 0] + 0.3 * rng.normal(size=60)), 1, 5)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, label double").coalesce(1)
    base = models.assembled(df, ["a", "b"]).cache()
    fitted = models.ridge(5.0, 60, float(np.std(y, ddof=1))).fit(base)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(fitted.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc), atol=1e-4)
    folded = with_folds(base, k=2).cache()
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 5
    got = models.out_of_fold(folded, models.logistic(1.0, 60), folds=2, first=1).collect()
    assert sorted(r.id for r in got) == list(range(60)) and {r.prediction for r in got} <= {1.0, 2.0, 3.0, 4.0, 5.0}
    assert sum(abs(r.prediction - r.label) for r in got) / 60 == pytest.approx(0.4, abs=0.4)
