import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from estima.functions.hashing import hash_hex
from estima.operators import evaluate as V
from estima.operators import score as R
from estima.operators import split as L
from estima.operators.models import pipeline_fit
from estima.sources.registry import model_load, model_metadata, model_save, score_sink


def test_split_and_folds_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = L.split_train_test(df, ["k"]).collect()
    b = L.split_train_test(df.repartition(13), ["k"]).collect()
    assert {r.k: r.is_test for r in a} == {r.k: r.is_test for r in b}
    f = L.kfold(df, ["k"], 3).groupBy("fold").count().collect()
    assert sorted(r.fold for r in f) == [0, 1, 2] and all(1500 < r["count"] < 1850 for r in f)


def test_hash_rank_equals_global_row_number(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3).withColumn("h", hash_hex(["id"]))
    got = L.hash_rank(df, "h", ["g"], tie_cols=["id"], digits=2).select("id", "rank")
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")).alias("rank"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_permute_column_is_permutation(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 10)
    p = L.permute_column(df, ["id"], "v", repeat=1)
    rows = p.collect()
    assert sorted(r.v for r in rows) == list(range(0, 10000, 10))
    assert sum(r.v == r.id * 10 for r in rows) < 20
    assert {r.id: r.v for r in rows} == {r.id: r.v for r in L.permute_column(df.repartition(5), ["id"], "v", repeat=1).collect()}


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(10, 2, 300)
    p = y + rng.normal(0.3, 1, 300)
    seg = np.where(np.arange(300) % 2 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "s": seg}))
    got = {r.s: r for r in V.metrics(df, "y", "p", ["s"]).collect()}
    for s in ["a", "b"]:
        yy, pp = y[seg == s], p[seg == s]
        n = len(yy)
        assert got[s]["mae"] == pytest.approx(np.mean(np.abs(yy - pp)))
        assert got[s]["r2"] == pytest.approx(1 - np.sum((yy - pp) ** 2) / np.sum((yy - yy.mean()) ** 2))
        sp = ((n - 1) * yy.var(ddof=1) + (n - 1) * pp.var(ddof=1)) / (2 * n - 2)
        t = (yy.mean() - pp.mean()) / math.sqrt(sp * 2 / n)
        assert got[s]["t_stat"] == pytest.approx(t)
        assert got[s]["dof"] == 2 * n - 2


def test_quality_score_definitions(spark):
    rows = [(0.95, 0.5, 0.1), (0.95, 0.01, 0.1), (0.5, 1.0, 5.0), (1.2, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "r2 double, p_value double, mae double")
    got = [(round(r.score, 4), r.grade) for r in V.quality_grade(df).collect()]
    assert got == [(85.1818, "Excellent"), (94.9818, "Excellent"), (33.3333, "Needs Improvement"), (80.0, "Good")]
    notes = V.significance_notes(df).collect()
    assert notes[1].significant and notes[1].notes == [V.MSG_SIGNIFICANT]
    assert notes[3].notes[-2:] == [V.MSG_CAUTION, V.MSG_RECOMMEND]


def test_constant_target_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 5, "y double, p double")
    r = V.metrics(df, "y", "p").first()
    assert r.r2 is None and r.t_stat is None and r.p_value is None and r.mae == 0.0


def test_training_rows_give_p_one(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "id": np.arange(200)})
    pdf["y"] = 3 * pdf.x + rng.normal(size=200)
    df = spark.createDataFrame(pdf)
    m = pipeline_fit(df, ["x"], "y", "ridge")
    r = V.metrics(R.predict(m, df), "y").first()
    assert abs(r.t_stat) < 1e-9 and r.p_value == pytest.approx(1.0)


@pytest.fixture(scope="module")
def model_and_rows(spark):
    rows = [(i, float(i % 17), ["Small", "Large", "Standard"][i % 3], 1.0 + 0.1 * (i % 17) + (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, Weight double, Size string, Price double")
    return pipeline_fit(df, ["Weight", "Size"], "Price", "ridge"), df


def test_inline_scoring_and_guard(spark, model_and_rows):
    m, df = model_and_rows
    req = spark.createDataFrame([(1, "Weight:3,Size:Large"), (2, "Size:Huge,Weight:4"), (3, "Weight:x,Size:Small")],
                                "id int, request string")
    out = {r.id: r for r in R.score_inline(m, req, "request", keep=["id"]).collect()}
    direct = R.predict(m, spark.createDataFrame([(3.0, "Large")], "Weight double, Size string")).first().prediction
    assert out[1].prediction == pytest.approx(direct)
    assert out[3].Weight is None
    from estima.sources.inline import inline_source
    parsed = inline_source(req, "request", R.feature_types(m), keep=["id"])
    probs = sorted((r.id, r.feature, r.problem) for r in R.score_guard(m, parsed, ["id"]).collect())
    assert probs == [(2, "Size", "unseen_category"), (3, "Weight", "null_value")]
    missing = R.score_guard(m, df.drop("Size"), ["id"]).where("problem = 'missing_column'").collect()
    assert [r.feature for r in missing] == ["Size"]


def test_model_registry_round_trip(spark, model_and_rows, tmp_dir):
    m, df = model_and_rows
    meta = model_metadata(spark, "ridge", ["Weight", "Size"], "Price", 0.9)
    path = model_save(m, meta, f"{tmp_dir}/model")
    b = model_load(spark, path)
    assert b.metadata["target_feature"] == "Price" and b.metadata["features"] == ["Weight", "Size"]
    assert len(b.metadata["training_date"]) == 19
    a1 = [r.prediction for r in R.predict(m, df).orderBy("id").collect()]
    a2 = [r.prediction for r in R.predict(b.model, df).orderBy("id").collect()]
    assert a1 == a2
    with pytest.raises(FileNotFoundError):
        model_load(spark, f"{tmp_dir}/nothing")
    out = R.score_batch(b.model, df.drop("Price").withColumn("Price", F.lit(0.0)), "Price", replace=True)
    assert out.columns == ["id", "Weight", "Size", "Price"]
    p = score_sink(out, f"{tmp_dir}/scored", "csv")
    assert spark.read.option("header", True).csv(p).count() == 300
    with pytest.raises(ValueError):
        score_sink(out, p, source_path=p)
    assert R.format_prediction(spark.createDataFrame([(1.005,), (2.0,)], "prediction double")).collect()[1].prediction_text == "2.00"


def test_plans_train_and_score(spark, model_and_rows, tmp_dir):
    from estima.plans import score, train
    _, df = model_and_rows
    res = train(df, "Price", ["id"], features=["Weight", "Size"], algorithm="ridge", expert=True)
    r = res.metrics.first()
    assert r.r2 > 0.9 and r.grade in ("Excellent", "Good")
    path = res.save(tmp_dir)
    scored, problems = score(spark, path, df.drop("Price"), key_cols=["id"])
    assert scored.count() == 300 and problems.count() == 0
    auto = train(df, "Price", ["id"], rank_trees=5, rank_depth=4, n_estimators=5, max_depth=4)
    assert auto.algorithm == "random_forest" and len(auto.features) == 2
    assert {row.column for row in auto.flags.collect()} >= set()


def test_prefix_digits_scale():
    assert L.prefix_digits(1000) == 1
    assert L.prefix_digits(10**12) == 5  # ~1M buckets of ~1M rows
    assert L.prefix_digits(10**20) == 8


def test_hash_rank_auto_digits(spark):
    df = spark.range(500).withColumn("h", hash_hex(["id"]))
    r = sorted(x["rank"] for x in L.hash_rank(df, "h", tie_cols=["id"]).collect())
    assert r == list(range(1, 501))


def test_sorted_rank_distributed(spark):
    df = spark.range(5000).select(F.format_string("c%05d", (F.col("id") * 7919) % 5000).alias("c"))
    got = L.sorted_rank(df, "c", "r", rows_per_partition=700).collect()
    assert sorted((r.r, r.c) for r in got) == [(i, f"c{i:05d}") for i in range(5000)]


def test_repartitioning_does_not_change_results(spark):
    from estima.operators import profile as P
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": np.arange(3000), "x": rng.normal(size=3000), "g": rng.choice(list("abc"), 3000)})
    df = spark.createDataFrame(pdf)
    a = sorted(P.profile_numeric(df, ["x"], ["g"], decimals=None).collect())
    b = sorted(P.profile_numeric(df.repartition(11, "k"), ["x"], ["g"], decimals=None).collect())
    assert [r.median for r in a] == [r.median for r in b] and [r.n for r in a] == [r.n for r in b]
    assert all(abs(x.mean - y.mean) < 1e-12 and abs(x.std - y.std) < 1e-12 for x, y in zip(a, b))



def test_inline_parsing_edge_cases(spark):
    from estima.sources.inline import inline_source
    req = spark.createDataFrame([(1, "a:1,a:2,b:x:y"), (2, "junk,b:,a:3.5"), (3, "")], "id int, r string")
    got = {r.id: (r.a, r.b) for r in inline_source(req, "r", {"a": "double", "b": "string"}, keep=["id"]).collect()}
    assert got == {1: (2.0, "x:y"), 2: (3.5, ""), 3: (None, None)}
