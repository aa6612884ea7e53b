import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estima.operators import encode as E
from estima.operators import importance as I
from estima.operators.models import make_regressor, pipeline_fit
from estima.operators.score import predict


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 600
    size = rng.choice(["Large", "Small", "Standard", "Size_2"], n)
    weight = rng.normal(20, 8, n)
    grams = rng.normal(500, 50, n)
    price = 1.0 + 0.05 * weight + np.select([size == "Large", size == "Small"], [0.6, -0.4], 0.0) + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({"id": np.arange(n), "weight_g": grams, "Weight": weight, "Size": size, "Price": price})
    return pdf, spark.createDataFrame(pdf)


def _sk_ridge(X, y, alpha):
    xm, ym = X.mean(0), y.mean()
    w = np.linalg.solve((X - xm).T @ (X - xm) + alpha * np.eye(X.shape[1]), (X - xm).T @ (y - ym))
    return ym - xm @ w, w


def _design(pdf, num, cat):
    cols = [(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in num]
    cats = {c: sorted(pdf[c].unique()) for c in cat}
    for c in cat:
        cols += [(pdf[c] == v).astype(float) for v in cats[c]]
    return np.column_stack(cols), cats


@pytest.mark.parametrize("alpha", [1.0, 0.5, 2.0])
def test_ridge_matches_closed_form_mixed(table, alpha):
    pdf, df = table
    num, cat = ["Weight", "weight_g"], ["Size"]
    m = pipeline_fit(df, num + cat, "Price", "ridge", alpha=alpha)
    X, _ = _design(pdf, num, cat)
    b0, w = _sk_ridge(X, pdf["Price"].values, alpha)
    reg = m.stages[-1]
    assert reg.intercept == pytest.approx(b0, rel=1e-9)
    assert reg.coefficients.toArray() == pytest.approx(w, rel=1e-7, abs=1e-9)


def test_slot_table_no_name_parsing(table, spark):
    pdf, df = table
    m = pipeline_fit(df, ["weight_g", "Size"], "Price", "ridge")
    rows = E.slot_rows(m)
    assert rows[0] == (0, "weight_g", "weight_g", None)
    assert [(r[2], r[3]) for r in rows[1:]] == [("Size", c) for c in sorted(pdf["Size"].unique())]
    imp = {r["feature"]: r["importance"] for r in I.importance_by_feature(
        I.named_weights(m, spark).withColumn("weight", F.abs("weight"))).collect()}
    assert set(imp) == {"weight_g", "Size"}


def test_unseen_and_null_categories_encode_to_zero(table, spark):
    pdf, df = table
    m = pipeline_fit(df, ["Size"], "Price", "ridge")
    reg = m.stages[-1]
    rows = spark.createDataFrame([("Huge",), (None,), ("Large",)], "Size string")
    got = [r["prediction"] for r in predict(m, rows).collect()]
    assert got[0] == pytest.approx(reg.intercept) and got[1] == pytest.approx(reg.intercept)
    assert got[2] != pytest.approx(reg.intercept)


def test_lasso_matches_coordinate_descent(table):
    pdf, df = table
    num = ["Weight", "weight_g"]
    m = pipeline_fit(df, num, "Price", "lasso", alpha=0.05)
    X, _ = _design(pdf, num, [])
    y = pdf["Price"].values
    Xc, yc, n = X - X.mean(0), y - y.mean(), len(y)
    w = np.zeros(X.shape[1])
    for _ in range(2000):
        for j in range(X.shape[1]):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - 0.05, 0) / (Xc[:, j] @ Xc[:, j] / n)
    assert m.stages[-1].coefficients.toArray() == pytest.approx(w, abs=1e-4)


def test_trees_fit_signal_and_importances(table, spark):
    pdf, df = table
    df4 = df.repartition(4, "id")
    for algo in ["random_forest", "xgboost"]:
        m = pipeline_fit(df4, ["Weight", "Size", "weight_g"], "Price", algo, n_estimators=10, max_depth=4)
        p = predict(m, df4).toPandas()
        r2 = 1 - ((p.Price - p.prediction) ** 2).sum() / ((p.Price - p.Price.mean()) ** 2).sum()
        assert r2 > 0.8
        w = I.model_weights(m, spark).toPandas()
        assert w.weight.sum() == pytest.approx(1.0)


def test_same_seed_same_forest(table):
    pdf, df = table
    df4 = df.repartition(4, "id")
    a = pipeline_fit(df4, ["Weight", "Size"], "Price", "random_forest", n_estimators=5, max_depth=3)
    b = pipeline_fit(df4, ["Weight", "Size"], "Price", "random_forest", n_estimators=5, max_depth=3)
    assert a.stages[-1].featureImportances == b.stages[-1].featureImportances


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        make_regressor("svm")
    assert make_regressor("randomforest").getNumTrees() == 100


def test_rank_select_and_rfe(table):
    pdf, df = table
    df4 = df.repartition(4, "id")
    rk = I.rank_features(df4, "Price", ["Weight", "Size", "weight_g"], n_estimators=10, max_depth=4).collect()
    assert rk[0]["feature"] == "Weight" and sum(r["importance_pct"] for r in rk) == pytest.approx(100, abs=0.05)
    sel = {r["feature"] for r in I.select_lasso(df4, "Price", ["Weight", "Size", "weight_g"], alpha=0.05).collect()}
    assert "Weight" in sel and "weight_g" not in sel
    rfe = {r["feature"] for r in I.select_rfe(df4, "Price", 2, ["Weight", "Size", "weight_g"],
                                               n_estimators=5, max_depth=4).collect()}
    assert rfe == {"Weight", "Size"}


def test_permutation_importance_ranks_signal(table):
    pdf, df = table
    m = pipeline_fit(df, ["Weight", "weight_g"], "Price", "ridge")
    imp = {r["feature"]: r for r in I.permutation_importance(m, df, ["Weight", "weight_g"], "Price", ["id"],
                                                             repeats=3).collect()}
    assert imp["Weight"]["importance"] > 0.9 and imp["Weight"]["importance_mean"] > 0.3


def test_grid_search_all_models(table):
    from estima.operators.tuning import grid_search
    pdf, df = table
    grids = {"ridge": {"alpha": [0.5, 2.0]}, "xgboost": {"n_estimators": [3, 5]}, "random_forest": {"n_estimators": [3, 6]}}
    tab, best = grid_search(df, ["Weight", "Size"], "Price", ["id"], grids=grids,
                            base_params={"xgboost": {"max_depth": 3}, "random_forest": {"max_depth": 4}})
    rows = tab.collect()
    assert len(rows) == 6 and sum(r.is_best for r in rows) == 3
    assert all(r.mean_r2 > 0.5 for r in rows if r.model == "ridge")
    assert best is not None and "prediction" in best.transform(df).columns


def test_ridge_with_constant_slots_is_exact(table, spark):
    pdf, df = table
    df2 = df.withColumn("flat", F.lit(3.0)).withColumn("one_cat", F.lit("only"))
    m = pipeline_fit(df2, ["Weight", "flat", "Size", "one_cat"], "Price", "ridge")
    X, _ = _design(pdf, ["Weight"], ["Size"])
    b0, w = _sk_ridge(X, pdf["Price"].values, 1.0)
    ws = {r.slot_name: r.weight for r in I.named_weights(m, spark).collect()}
    assert ws["flat"] == 0.0 and ws["one_cat_only"] == 0.0
    assert ws["Weight"] == pytest.approx(w[0], rel=1e-9)
    assert [ws[f"Size_{c}"] for c in sorted(pdf["Size"].unique())] == pytest.approx(list(w[1:]), rel=1e-8)
    p = predict(m, df2).select("prediction").first()[0]
    assert p == pytest.approx(predict(pipeline_fit(df, ["Weight", "Size"], "Price", "ridge"), df).select("prediction").first()[0], rel=1e-9)


def test_boolean_feature_and_lookalike_names(spark):
    from estima.operators.columns import column_roles
    rows = [(i, i % 2 == 0, ["S", "M_L"][i % 2], ["x", "y", "z"][i % 3], 1.0 + (i % 2) + 0.1 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, flag boolean, Size string, Size2 string, Price double")
    roles = {r.column: r.role for r in column_roles(df).collect()}
    assert roles["flag"] == "categorical" and roles["Size2"] == "categorical"
    m = pipeline_fit(df, ["flag", "Size", "Size2"], "Price", "ridge")
    slots = [(r[2], r[3]) for r in E.slot_rows(m)]
    assert slots == [("flag", "false"), ("flag", "true"), ("Size", "M_L"), ("Size", "S"),
                     ("Size2", "x"), ("Size2", "y"), ("Size2", "z")]
    imp = {r.feature: r.importance for r in I.importance_by_feature(
        I.named_weights(m, spark).withColumn("weight", F.abs("weight"))).collect()}
    assert set(imp) == {"flag", "Size", "Size2"}


def test_rows_of_one_task_are_dealt_over_all_cores(spark, monkeypatch):
    from estima.operators import models as mod
    monkeypatch.setattr(mod, "SPREAD_ROWS", 1000)
    rows = spark.range(4000).coalesce(1).selectExpr("cast(id % 50 as double) x", "cast(id as double) y").persist()
    even = mod.spread(rows)
    held = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == spark.sparkContext.defaultParallelism and max(held) <= 2 * min(held)
    assert even.agg(F.sum("y")).first()[0] == 3999 * 2000
    assert mod.spread(even) is even
    even.unpersist()
    few = spark.range(999).coalesce(1).persist()
    assert mod.spread(few) is few
    few.unpersist()
