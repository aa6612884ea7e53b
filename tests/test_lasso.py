"""Lasso on the Gram matrix: its certificate, collinear blocks, rows without variation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estima.operators.lasso import certificate, descent, violation
from estima.operators.models import LABEL_COL, linear_terms, pipeline_fit
from estima.operators.encode import FEATURES_COL, slot_rows


def test_descent_meets_its_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 30)) @ rng.normal(size=(30, 30))
    x -= x.mean(0)
    y = x[:, :5] @ rng.normal(size=5) * 3 + rng.normal(size=400)
    y -= y.mean()
    gram, target = x.T @ x / 400, x.T @ y / 400
    w, off = descent(gram, target, 2.0)
    assert off <= 1e-9 * np.abs(target).max() and 0 < (w != 0).sum() < 30
    assert violation(w, x.T @ (y - x @ w) / 400, 2.0) < 1e-8
    best = ((y - x @ w) ** 2).mean() / 2 + 2 * np.abs(w).sum()
    for _ in range(200):
        other = w + rng.normal(size=30) * 1e-3
        assert ((y - x @ other) ** 2).mean() / 2 + 2 * np.abs(other).sum() >= best - 1e-9


@pytest.mark.parametrize("alpha", [0.05, 1.0, 1e6])
def test_fitted_model_holds_its_certificate(spark, alpha):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), f"k{i % 3}", 5.0, float(1e5 + 4 * a + 3 * (i % 3) + e)) for i, (a, e) in enumerate(rng.normal(size=(300, 2)))],
                               "a double, k string, one double, y double")
    model = pipeline_fit(df, ["a", "one", "k"], "y", "lasso", alpha=alpha)
    data = df
    for stage in model.stages[:-1]:
        data = stage.transform(data)
    b0, w = linear_terms(model, len(slot_rows(model)))
    rows = certificate(data, w, b0, alpha, FEATURES_COL, LABEL_COL).collect()
    assert len(rows) == 5 and max(r["violation"] for r in rows) < 1e-7
    assert w[1] == 0 and (alpha < 1e6 or not any(w))
    off = certificate(data, [x + 0.1 for x in w], b0, alpha, FEATURES_COL, LABEL_COL).agg(F.max("violation")).first()[0]
    assert off > 1e-3
