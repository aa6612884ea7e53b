"""The forest of large tables: equal to Spark's trees without draws, draws that do not depend on the layout, exact cuts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel

from estima.operators import cuts, forest


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROWS", 50)
    return monkeypatch


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 30, n), rng.integers(0, 2, n), rng.integers(0, 9, n)], 1).astype(float)
    y = np.round(x[:, 0] * 3 + x[:, 1] * x[:, 2] * 5 + rng.integers(0, 9, n))
    rows = spark.createDataFrame([(r, float(v)) for r, v in zip(x.tolist(), y, strict=True)], "a array<double>, label double")
    return rows.select(array_to_vector("a").alias("features"), "label")


def predictions(model, rows):
    return np.array([r[0] for r in model.transform(rows).select("prediction").collect()])


def estimator(trees, **more):
    return forest.RandomForest(numTrees=trees, maxDepth=5, maxBins=64, featureSubsetStrategy="all", seed=3, **more)


@pytest.mark.parametrize("whole", [10**9, 0])
def test_trees_without_draws_are_sparks(spark, small, whole):
    small.setattr(forest, "WHOLE_BYTES", whole)
    small.setattr(forest, "BLOCK_ROWS", 300)
    rows = table(spark).repartition(4).persist()
    model, plain = estimator(2, bootstrap=False).fit(rows), DecisionTreeRegressor(maxDepth=5, maxBins=64).fit(rows)
    assert isinstance(model, RandomForestRegressionModel) and model.getNumTrees == 2 and model.trees[0].numNodes == plain.numNodes
    assert np.allclose(predictions(model, rows), predictions(plain, rows), rtol=0, atol=1e-9)
    assert np.allclose(model.featureImportances.toArray(), plain.featureImportances.toArray())
    root, its = model.trees[0]._java_obj.rootNode(), plain._java_obj.rootNode()
    assert root.impurity() == pytest.approx(its.impurity()) and root.gain() == pytest.approx(its.gain())


def test_draws_depend_on_the_rows_only(spark, small, tmp_dir):
    rows = table(spark).persist()
    rows = rows.union(rows.limit(100))  # some rows come twice
    first = estimator(6).fit(rows.repartition(5))
    small.setattr(forest, "WHOLE_BYTES", 0)
    small.setattr(forest, "BLOCK_ROWS", 97)
    small.setattr(forest, "TILE_ROWS", 13)
    small.setattr(forest, "LEVEL_BYTES", 30_000)
    second = estimator(6).fit(rows.repartition(2))
    assert np.allclose(predictions(first, rows), predictions(second, rows), rtol=0, atol=1e-9)
    assert len({t.numNodes for t in first.trees} | {round(float(t._java_obj.rootNode().prediction()), 6) for t in first.trees}) > 2
    first.write().save(f"{tmp_dir}/m")
    assert (predictions(RandomForestRegressionModel.load(f"{tmp_dir}/m"), rows) == predictions(first, rows)).all()


def test_draws_are_poisson():
    for mean in (1.0, 0.5):
        at = forest.poisson(mean)
        count = sum((np.arange(65536) >= t).astype(int) for t in at)
        assert abs(count.mean() - mean) < 1e-3 and abs(count.var() - mean) < 1e-3
    n, y = 40_000, np.sort(np.random.default_rng(1).random(40_000))
    row = {"counts": np.array([n // 2, n // 2], np.int32).tobytes(), "bins": bytes([0, 1]), "target": y.tobytes(), "before": 0}
    block = forest.Block(row, 1, np.uint8, 0.0)
    each = np.array([block.drawn(0, t, forest.poisson(1.0), squares=True)[0] for t in range(12)])
    assert (abs(each - n // 2) < 6 * np.sqrt(n / 2)).all() and len(np.unique(each[:, 0])) > 8
    assert abs(np.corrcoef(each[:, 0], each[:, 1])[0, 1]) < 0.95


def test_a_large_cell_lies_in_several_tasks(spark):
    rows = spark.createDataFrame([([1.0], float(i)) for i in range(4000)], "a array<double>, label double").select(array_to_vector("a").alias("features"), "label")
    held = forest.Cells(rows.repartition(3), "features", "label", 64).blocks.select("part").distinct().count()
    assert held > 1


@pytest.mark.parametrize("few", [10, 10**6])
def test_cuts_equal_exact_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(cuts, "FEW_VALUES", few)
    rng, n = np.random.default_rng(0), 5000
    x = np.stack([rng.normal(size=n) * 10.0 ** rng.integers(-30, 30, n), rng.integers(0, 40, n).astype(float), np.where(rng.random(n) < 0.4, 7.25, rng.normal(size=n)),
                  np.where(rng.random(n) < 0.02, np.nan, rng.random(n)), np.full(n, 2.0)], 1)
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "a array<double>").select(array_to_vector("a").alias("features")).repartition(3)
    got = cuts.cut_points(rows, "features", 64)
    for i in range(x.shape[1]):
        v = x[~np.isnan(x[:, i]), i]
        u = np.unique(v)
        want = (u[:-1] + u[1:]) / 2 if len(u) <= 64 else np.unique(np.quantile(v, np.arange(1, 64) / 64))
        assert len(got[i]) == len(want) and np.allclose(got[i], want, rtol=1e-14, atol=0)
