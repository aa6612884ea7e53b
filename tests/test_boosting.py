"""Second-order boosting against a plain exact search, with missing values, in a task and across tasks."""

import math
import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from estima.operators.boosting import BoostedTreesModel
from estima.operators.models import model_pipeline, pipeline_fit, regressor_stage


def plain_tree(x, g, depth, penalty=1.0, least=1.0):
    """Leaf values -G/(n + penalty) of the rows after an exact greedy search over all cuts."""
    total, n = g.sum(), len(g)
    best = (1e-6, None)
    if depth:
        for s in range(x.shape[1]):
            v, there = x[:, s], ~np.isnan(x[:, s])
            values = np.unique(v[there])
            for cut in [(a + b) / 2 for a, b in zip(values, values[1:])] + ([math.inf] if (~there).any() and there.any() else []):
                for missing_left in (False, True):
                    left = np.where(there, v < cut, missing_left)
                    a, b = left.sum(), (~left).sum()
                    if min(a, b) < least:
                        continue
                    gain = g[left].sum() ** 2 / (a + penalty) + g[~left].sum() ** 2 / (b + penalty) - total**2 / (n + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
    if best[1] is None:
        return np.full(n, -total / (n + penalty))
    out = np.empty(n)
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], g[side], depth - 1, penalty, least)
    return out


def plain_boosting(x, y, rounds, depth, rate=0.3):
    p = np.full(len(y), 0.5)
    for _ in range(rounds):
        p = p + rate * plain_tree(x, p - y, depth)
    return p


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 300
    x = np.column_stack([rng.integers(0, 40, n).astype(float), rng.normal(size=n).round(2), rng.integers(0, 3, n).astype(float)])
    x[rng.random((n, 3)) < 0.08] = np.nan
    y = np.nan_to_num(x[:, 0], nan=70) * 2 + np.nan_to_num(x[:, 1], nan=-3) * 5 + rng.normal(size=n)
    return x, y


def frame(spark, x, y):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(3)


def predicted(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").select("prediction").collect()])


@pytest.mark.parametrize("rounds, depth", [(1, 1), (1, 2), (4, 4)])
def test_rounds_equal_an_exact_search(spark, data, rounds, depth):
    x, y = data
    df = frame(spark, x, y)
    model = pipeline_fit(df, ["a", "b", "c"], "y", "xgboost", n_estimators=rounds, max_depth=depth)
    np.testing.assert_allclose(predicted(model, df), plain_boosting(x, y, rounds, depth), rtol=1e-9)


def test_across_tasks_equals_in_one_task(spark, data, tmp_dir):
    x, y = data
    df = frame(spark, x, y).withColumn("k", F.when(F.col("id") % 5 != 0, F.concat(F.lit("k"), F.col("id") % 4)))
    here = pipeline_fit(df, ["a", "b", "k"], "y", "xgboost", n_estimators=5, max_depth=3)
    pipe = model_pipeline(["a", "b"], ["k"], "y", "xgboost", n_estimators=5, max_depth=3)
    pipe.getStages()[-1]._set(cells=0)
    there = pipe.fit(df)
    np.testing.assert_allclose(predicted(there, df), predicted(here, df), rtol=1e-9)
    # saved, loaded, cut to its first rounds
    path = os.path.join(tmp_dir, "boosted")
    here.write().overwrite().save(path)
    np.testing.assert_array_equal(predicted(PipelineModel.load(path), df), predicted(here, df))
    whole = regressor_stage(here)
    assert isinstance(whole, BoostedTreesModel) and abs(sum(whole.featureImportances.toArray()) - 1) < 1e-9
    short = PipelineModel(stages=[*here.stages[:-1], whole.prefix(2)])
    own = pipeline_fit(df, ["a", "b", "k"], "y", "xgboost", n_estimators=2, max_depth=3)
    np.testing.assert_array_equal(predicted(short, df), predicted(own, df))


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 1))
    df = frame(spark, np.column_stack([x, x, x]), 3 * x[:, 0])
    model = pipeline_fit(df, ["a"], "y", "xgboost", n_estimators=60, max_bins=32)
    assert np.abs(predicted(model, df) - 3 * x[:, 0]).mean() < 0.2


def test_nothing_to_learn_from(spark):
    df = frame(spark, np.zeros((0, 3)), np.zeros(0))
    assert model_pipeline(["a"], [], "y", "xgboost", n_estimators=2).fit(df).transform(df).count() == 0
    same = frame(spark, np.ones((4, 3)), np.full(4, 2.0))
    got = predicted(pipeline_fit(same, ["a", "b"], "y", "xgboost", n_estimators=1), same)
    np.testing.assert_allclose(got, 0.5 + 0.3 * 4 * 1.5 / 5)


def test_rows_in_a_task_go_on_by_one_level(monkeypatch):
    """Rows keep their node: no level starts at the root again, and the trees are those of the plain sums."""
    from estima.operators import boosting as B
    r = np.random.default_rng(3)
    first = np.array([0, 9, 12, 20])
    bins = np.stack([r.integers(0, n, 700) for n in (9, 3, 8)], 1).astype(np.uint16)
    y = bins[:, 0] * 1.5 + (bins[:, 2] % 3) + r.normal(size=700)

    class Plain(B.Here):
        def __init__(self, *args):
            super().__init__(*args)
            self.rows = bins

        def histogram(self, tree, nodes):
            return B.summed(self.rows, self.predicted - self.target, tree.leaves(self.rows, self.missing), nodes, self.first)

        def add(self, tree):
            self.predicted += tree.value[tree.leaves(self.rows, self.missing)]

    want = B.boosted(Plain(bins, y, first, 0.5), 4, 4, 0.3, 1.0, 1.0)
    monkeypatch.delattr(B.Tree, "leaves")
    got = B.boosted(B.Here(bins, y, first, 0.5), 4, 4, 0.3, 1.0, 1.0)
    for a, b in zip(got, want, strict=True):
        assert (a.slot == b.slot).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_rows_of_the_same_bins_are_one(spark, data):
    """Large tables: with equal rows counted once, in one task or across tasks, the trees are those of all rows."""
    x, y = data
    df = frame(spark, np.concatenate([x, x, x[:50]]), np.concatenate([y, y + 1, y[:50]])).withColumn("a", F.round("a", 1)).persist()
    here = pipeline_fit(df, ["a", "b"], "y", "xgboost", n_estimators=4, max_depth=3)
    for cells in (df.select("a", "b").distinct().count() * 2, 0):
        assert cells < df.count() * 2
        pipe = model_pipeline(["a", "b"], [], "y", "xgboost", n_estimators=4, max_depth=3)
        pipe.getStages()[-1]._set(cells=cells)
        np.testing.assert_allclose(predicted(pipe.fit(df), df), predicted(here, df), rtol=1e-9)


def test_the_driver_keeps_no_plan_of_a_round(spark, data):
    x, y = data
    df = frame(spark, x, y).persist()
    store = spark._jsparkSession.sharedState().statusStore()

    def plans(rounds):
        pipe = model_pipeline(["a", "b"], [], "y", "xgboost", n_estimators=rounds, max_depth=3)
        pipe.getStages()[-1]._set(cells=0)
        before = store.executionsCount()
        pipe.fit(df)
        return store.executionsCount() - before

    plans(1)
    assert plans(2) == plans(9)
