"""Charts of awkward values: NaN, infinities, constants, texts, far outliers."""

import math

import numpy as np
import pytest

from estima.operators import chartdata as D

ODD = [(1.0, 1.0), (2.0, 2.5), (3.0, 2.0), (4.0, float("nan")), (5.0, float("inf")), (6.0, None), (None, 1.0), (7.0, 6.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "y double, prediction double")


@pytest.mark.parametrize("chart", [D.actual_vs_predicted, D.error_vs_predicted])
def test_one_odd_value_does_not_spoil_a_scatter(odd, chart):
    rows = chart(odd, "y").collect()
    assert sum(r["count"] for r in rows) == 4
    assert all(math.isfinite(r[c]) for r in rows for c in ("x_lo", "x_hi", "y_lo", "y_hi"))


def test_density_of_odd_and_of_constant_residuals(spark, odd):
    rows = D.residual_density(odd, "y").collect()
    assert len(rows) == 200 and all(math.isfinite(r["density"]) for r in rows)
    same = spark.createDataFrame([(float(i), float(i) - 2) for i in range(5)], "y double, prediction double")
    assert [tuple(r) for r in D.residual_density(same, "y").collect()] == [(0, 2.0, math.inf, 5.0)]
    assert D.residual_density(same.limit(0), "y").collect() == []


def test_far_outlier_lists_only_bins_with_values(spark):
    values = [float(i % 7) for i in range(2000)] + [1e12]
    df = spark.createDataFrame([(v, 0.0) for v in values], "y double, prediction double")
    rows = D.residual_hist_auto(df, "y").collect()
    assert len(rows) < 10 and sum(r["count"] for r in rows) == 2001
    assert max(r["bin"] for r in rows) > 2**31


def test_texts_are_counted_and_numbers_binned(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 4.0), (None, None)], "t string, x double")
    rows = D.column_charts(df, ["t", "x"], 3).collect()
    assert sorted((r["value"], r["count"]) for r in rows if r["column"] == "t") == [("a", 2), ("b", 1)]
    assert [(r["bin"], r["count"]) for r in sorted((r for r in rows if r["column"] == "x"), key=lambda r: r["bin"])] == [(0, 1), (1, 1), (2, 1)]
    x = np.random.default_rng(1).normal(size=500)
    auto = D.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], "auto").orderBy("bin").collect()
    count, edges = np.histogram(x, "auto")
    assert [r["count"] for r in auto] == count.tolist() and abs(auto[0]["lo"] - edges[0]) < 1e-12


def test_trend_with_an_extreme_x_and_ties(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 30, 600).astype(float), [1e9]])
    y = 2 * x + rng.normal(size=601) * 0.01
    rows = D.lowess_trend(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").orderBy("point").collect()
    assert rows[0]["trend"] == pytest.approx(0, abs=0.1)
