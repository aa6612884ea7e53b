import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estima.operators import chartdata as D


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(50, 10, 2000)
    p = y + rng.normal(0, 3, 2000) + 0.05 * (y - 50)
    return pd.DataFrame({"k": np.arange(2000), "y": y, "p": p}), spark.createDataFrame(
        pd.DataFrame({"k": np.arange(2000), "y": y, "p": p}))


def test_histogram_counts_match_numpy(preds):
    pdf, df = preds
    got = D.histogram(df, ["y", "p"], 30).orderBy("column", "bin").toPandas()
    for c in ["y", "p"]:
        counts, edges = np.histogram(pdf[c], bins=30)
        g = got[got.column == c]
        assert list(g["count"]) == list(counts)
        assert np.allclose(g["lo"], edges[:-1]) and np.allclose(g["hi"], edges[1:])


def test_single_column_and_constant_histogram(spark):
    df = spark.createDataFrame([(3.0,)] * 10, "x double")
    got = D.histogram(df, ["x"], 5).orderBy("bin").collect()
    assert sum(r["count"] for r in got) == 10 and got[0].lo == 2.5 and got[-1].hi == 3.5


def test_auto_bins_matches_numpy(preds):
    pdf, df = preds
    r = D.residuals(df, "y", "p")
    assert D.auto_bins(r, "residual") == len(np.histogram_bin_edges(pdf.y - pdf.p, bins="auto")) - 1


def test_kde_close_to_exact(preds):
    pdf, df = preds
    res = (pdf.y - pdf.p).values
    got = D.residual_density(df, "y", "p").orderBy("point").toPandas()
    bw = res.std(ddof=1) * len(res) ** (-0.2)
    x = got.x.values
    exact = np.exp(-0.5 * ((x[:, None] - res[None, :]) / bw) ** 2).sum(1) / (len(res) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(got.density.values, exact, rtol=2e-3, atol=1e-6)


def test_detrended_residuals_have_no_slope(preds):
    pdf, df = preds
    out = D.residual_vs_predicted(df, "y", ["k"], "p").toPandas()
    assert abs(np.polyfit(out.prediction, out.detrended, 1)[0]) < 1e-9
    tr = D.lowess_trend(D.residuals(df, "y", "p"), "p", "residual").toPandas()
    assert len(tr) == 100 and tr.trend.notna().all()


def test_binned_scatter_totals(preds):
    pdf, df = preds
    for t in (D.actual_vs_predicted(df, "y", "p"), D.error_vs_predicted(df, "y", "p")):
        assert t.agg(F.sum("count")).first()[0] == 2000


def test_streaming_scoring(spark, tmp_dir):
    from estima.operators.models import pipeline_fit
    from estima.streaming import start_scoring
    rows = [(float(i), 2.0 * i + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double")
    m = pipeline_fit(df, ["x"], "y", "ridge")
    src = f"{tmp_dir}/in"
    df.select("x").write.parquet(src)
    stream = spark.readStream.schema("x double").parquet(src)
    q = start_scoring(m, stream, f"{tmp_dir}/out", available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == 50 and set(out.columns) == {"x", "prediction"}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "grade" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80


def _np_lowess_grid(x, y, grid, frac=2 / 3, iterations=3):
    """Brute force of the same robust LOWESS on raw rows (no binning)."""
    n = len(x)
    k = int(np.ceil(frac * n))
    rob = np.ones(n)
    trend = None
    for it in range(iterations + 1):
        if trend is not None:
            e = y - np.interp(x, grid, trend)
            mad = np.median(np.abs(e))
            u = e / (6 * mad)
            rob = np.where(np.abs(u) < 1, (1 - u ** 2) ** 2, 0.0)
        out = []
        for g in grid:
            d = np.abs(x - g)
            h = np.sort(d)[k - 1]
            t = np.where(d / h < 1, (1 - (d / h) ** 3) ** 3, 0.0) * rob
            W, WX, WY = t.sum(), (t * x).sum(), (t * y).sum()
            WXX, WXY = (t * x * x).sum(), (t * x * y).sum()
            den = W * WXX - WX * WX
            b = (W * WXY - WX * WY) / den if den else 0.0
            out.append((WY - b * WX) / W + b * g)
        trend = np.array(out)
    return trend


def test_lowess_close_to_brute_force_and_robust(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 10, 3000)
    clean = np.sin(x) + rng.normal(0, 0.2, 3000)
    y = clean.copy()
    y[::50] += 25.0  # outliers the robustness passes must discount
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = D.lowess_trend(df, "x", "y", points=40).orderBy("point").toPandas()
    grid = got.x.values
    assert np.allclose(got.trend.values, _np_lowess_grid(x, y, grid), atol=0.03)  # binning error only
    ref_clean = _np_lowess_grid(x, clean, grid)
    assert np.abs(got.trend.values - ref_clean).max() < 0.1  # outliers discounted
    plain = D.lowess_trend(df, "x", "y", points=40, iterations=0).orderBy("point").toPandas()
    assert np.abs(plain.trend.values - ref_clean).max() > 0.3  # a single pass is pulled up


def test_lowess_with_one_extreme_x(spark):
    rng = np.random.default_rng(4)
    for far in (1e6, -1e6):
        x = np.append(rng.uniform(0, 10, 2000), far)
        y = np.append(3 * x[:-1] + rng.normal(0, 0.2, 2000), 5.0)
        df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
        got = D.lowess_trend(df, "x", "y", points=20, iterations=0).orderBy("point").toPandas()
        want = _np_lowess_grid(x, y, got.x.values, iterations=0)
        near = np.argmin(np.abs(got.x.values - 5))  # the grid point in the mass
        assert got.trend.notna().all()
        assert abs(got.trend.values[near] - want[near]) < 0.05 * (1 + abs(want[near]))
        robust = D.lowess_trend(df, "x", "y", points=20)
        assert robust.where("trend is null").count() == 0


def test_lowess_on_one_value_and_another(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0] * 90 + [5.0] * 10, "y": [2.0, 4.0] * 45 + [7.0] * 10}))
    got = D.lowess_trend(df, "x", "y", points=5).orderBy("point").toPandas()
    assert got.trend.notna().all() and abs(got.trend.values[0] - 3.0) < 1e-9
