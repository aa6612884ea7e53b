"""CSV shapes of real files, ranks of wide frames, restarted streams, guards."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.operators import quality as Q
from estima.operators.evaluate import metrics, significance_notes
from estima.operators.split import sorted_rank
from estima.sources import csv as CSV
from estima.sources.inline import inline_source


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_quotes_line_breaks_codes_and_odd_names(spark, tmp_dir):
    path = write(tmp_dir, "a.csv", 'id,"buyer\'s",unit.price,code,note\n1,"say ""hi"", now",1.5,10d,"two\nlines"\n2,x,1e3,12f,#N/A\n')
    df = CSV.scan_csv(spark, path, multi_line=True)
    assert df.columns == ["id", "buyer's", "unit.price", "code", "note"]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 'say "hi", now', 1.5, "10d", "two\nlines"), (2, "x", 1000.0, "12f", None)]
    kinds = {r["column"]: r["inferred_type"] for r in CSV.infer_types(CSV.read_csv_text(spark, path, multi_line=True)).collect()}
    assert kinds["code"] == "text" and kinds["unit.price"] == "float" and kinds["id"] == "integer"
    bad = {r["column"]: r["n_missing"] for r in Q.missing_by_column(CSV.read_csv_text(spark, path, multi_line=True)).collect()}
    assert bad == {"id": 0, "buyer's": 0, "unit.price": 0, "code": 0, "note": 1}
    mixed = {r["column"]: r["n_numeric"] for r in Q.check_mixed_types(CSV.read_csv_text(spark, path, multi_line=True)).collect()}
    assert mixed["code"] == 0 and mixed["unit.price"] == 2
    assert Q.check_readable(spark, path, multi_line=True).first()["n_malformed"] == 0


def test_scoring_files_are_read_by_name(spark, tmp_dir):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b.c", T.DoubleType()), T.StructField("s", T.StringType())])
    path = write(tmp_dir, "s.csv", "extra,s,b.c,a\nx,k,2.5,1\ny,NA,10d,zz\n")
    got = [tuple(r) for r in CSV.score_csv_source(spark, path, schema).collect()]
    assert got == [(1, 2.5, "k"), (None, None, None)]
    with pytest.raises(ValueError, match="b.c"):
        CSV.score_csv_source(spark, write(tmp_dir, "t.csv", "a,s\n1,k\n"), schema)


def test_folders_bind_by_name(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "d")
    write(folder, "1.csv", "a,b\n1,x\n2,y\n")
    write(folder, "2.csv", "b,a\nz,3\n")
    assert sorted(tuple(r) for r in CSV.scan_csv(spark, folder).collect()) == [(1, "x"), (2, "y"), (3, "z")]
    write(folder, "3.csv", "b,c\nz,3\n")
    with pytest.raises(ValueError, match="other columns"):
        CSV.scan_csv(spark, folder)


@pytest.mark.parametrize("text,sep", [('a;b\n"x;y";1\n', ";"), ('a,b\n"1;2;3",4\n', ","), ("only\n1\n2\n", ","), ("a|b|c\n1|2|3\nbroken\n4|5|6\n", "|")])
def test_delimiters(spark, tmp_dir, text, sep):
    assert CSV.sniff_delimiter(spark, write(tmp_dir, "x.csv", text)) == sep


def test_no_delimiter_fits(spark, tmp_dir):
    with pytest.raises(ValueError):
        CSV.sniff_delimiter(spark, write(tmp_dir, "x.csv", "a,b\n1\n2,3,4\n5,6,7,8\n9\n"))


def test_ranks_of_a_wide_frame(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"), F.md5(F.col("id").cast("string")).alias("p"), F.rand(1).alias("q")).repartition(16)
    got = sorted_rank(df, "v", rows_per_partition=1000)
    assert dict(got.dtypes)["rank"] == "bigint"
    rows = sorted((r["v"], r["rank"]) for r in got.select("v", "rank").collect())
    assert [r for _, r in rows] == list(range(20_000))


def test_inline_last_value_and_problems(spark):
    df = spark.createDataFrame([(1, "w:1,w:2,c:x"), (2, "w3,c:y,zz:1"), (3, "w:4")], "k int, r string")
    got = {r["k"]: (r["w"], r["c"], r["bad"]) for r in inline_source(df, "r", {"w": "double", "c": "string"}, ["k"], problem_col="bad").collect()}
    assert got == {1: (2.0, "x", None), 2: (None, "y", "w3,zz:1"), 3: (4.0, None, None)}


def test_metrics_skip_nan_and_a_missing_p_value_is_not_significant(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, float("nan")), (float("nan"), 1.0)], "y double, prediction double")
    r = significance_notes(metrics(df, "y")).first()
    assert r["n"] == 1 and r["mae"] == 0.5 and r["p_value"] is None and r["significant"] is False and r["notes"]


def test_a_restarted_stream_goes_on(spark, tmp_dir):
    from estima.operators.models import pipeline_fit
    from estima.streaming.scoring import start_scoring
    train = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(30)], "x double, y double")
    model = pipeline_fit(train, ["x"], "y")
    source, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    for step in range(2):
        write(source, f"{step}.json", "\n".join(json.dumps({"x": float(10 * step + i)}) for i in range(3)))
        stream = spark.readStream.schema("x double").json(source)
        query = start_scoring(model, stream, out, available_now=True)
        query.awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0]


@pytest.mark.parametrize("categories", [1000, 4200, 50_000])
def test_ridge_has_one_objective_at_every_width(spark, categories):
    import numpy as np

    from estima.operators.importance import named_weights
    from estima.operators.models import pipeline_fit
    rng = np.random.default_rng(categories)
    n = (4 if categories < 50_000 else 2) * categories
    c = np.concatenate([np.arange(categories), rng.integers(0, categories, n - categories)])
    y = rng.normal(size=categories)[c] * 30 + rng.normal(size=n)
    df = spark.createDataFrame([(f"k{a:05d}", float(b)) for a, b in zip(c, y, strict=True)], "c string, y double")
    got = {r["category"]: r["weight"] for r in named_weights(pipeline_fit(df, ["c"], "y"), spark).collect()}
    count, mean = np.bincount(c), np.bincount(c, weights=y) / np.bincount(c)
    base = (count * mean / (count + 1)).sum() / (count / (count + 1)).sum()
    want = count * (mean - base) / (count + 1)
    assert max(abs(got[f"k{i:05d}"] - want[i]) for i in range(categories)) < 1e-9 * 100  # weights are near 100


def test_ridge_eliminates_only_the_widest_block(spark):
    """Numbers, a wide and a narrow block, a constant slot: the dense normal equations; the same by DataFrame."""
    import numpy as np

    from estima.operators.models import linear_terms, pipeline_fit
    from estima.operators.ridge import wide_ridge
    rng = np.random.default_rng(9)
    n, wide = 3000, 1100
    a, k, c, one = rng.normal(size=n) * 7 + 50, rng.integers(0, wide, n), rng.integers(0, 4, n), np.full(n, 3.0)
    y = 1e6 + 5 * a + rng.normal(size=wide)[k] * 40 + c * 10 + rng.normal(size=n)
    df = spark.createDataFrame([(float(p), f"k{q:04d}", f"c{r}", 3.0, float(t)) for p, q, r, t in zip(a, k, c, y, strict=True)], "a double, k string, c string, one double, y double")
    hot = lambda v: (v[:, None] == np.unique(v)[None, :]).astype(float)

    def dense(*columns):
        x = np.column_stack(columns)
        w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 2.0 * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
        return y.mean() - x.mean(0) @ w, w

    z = (a - a.mean()) / a.std()
    intercept, want = dense(z, one * 0, hot(k), hot(c))
    got = linear_terms(pipeline_fit(df, ["a", "one", "k", "c"], "y", "ridge", alpha=2.0), len(want))
    assert abs(got[0] - intercept) < 1e-9 * 1e6
    np.testing.assert_allclose(got[1], want, rtol=1e-9, atol=1e-7)
    intercept, want = dense(z, hot(k))
    b0, numbers, weights = wide_ridge(df, "k", ["a"], "y", alpha=2.0)
    assert abs(b0 - intercept) < 1e-9 * 1e6 and abs(numbers["a"] - want[0]) < 1e-7
    np.testing.assert_allclose([r["weight"] for r in weights.orderBy("category").collect()], want[1:], atol=1e-7)


def test_one_fit_scores_all_its_prefixes(spark):
    """A search fits once a family; a prefix scores as the same trees scored on their own."""
    import numpy as np

    from estima.operators.models import pipeline_fit, regressor_stage
    from estima.operators.tuning import families, grid_search, nested_scores, prefix
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a + b * b)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y double")
    assert [len(f) for f in families("random_forest", [{"n_estimators": 3, "max_depth": d} for d in (2, 3)] + [{"n_estimators": 5, "max_depth": 2}], {})] == [2, 1]
    model = pipeline_fit(df, ["a", "b"], "y", "random_forest", n_estimators=6)
    data = df
    for stage in model.stages[:-1]:
        data = stage.transform(data)
    short = prefix(regressor_stage(model), 2)
    each = [t.transform(data.select("features")).select("prediction").collect() for t in regressor_stage(model).trees[:2]]
    np.testing.assert_allclose([r["prediction"] for r in short.transform(data).select("prediction").collect()],
                               [(p["prediction"] + q["prediction"]) / 2 for p, q in zip(*each, strict=True)])
    for algo, key, values in (("ridge", "alpha", (0.5, 2.0)), ("xgboost", "n_estimators", (2, 6))):
        family = [({key: v}, {key: v}) for v in values]
        together = nested_scores(algo, family, data, data)
        for one, (_, point, r2) in zip(family, together, strict=True):
            assert abs(nested_scores(algo, [one], data, data)[0][2] - r2) < 1e-12
    table, best = grid_search(df, ["a", "b"], "y", ["id"], grids={"ridge": {"alpha": [1.0, 2.0]}, "xgboost": {"n_estimators": [2, 20]},
                                                                  "random_forest": {"n_estimators": [2, 5]}})
    assert table.count() == 6 and best is not None and {r["model"] for r in table.where("is_best").collect()} == {"ridge", "xgboost", "random_forest"}


def test_checked_load_and_training_from_csv(spark, tmp_dir):
    from estima.plans import checked_csv, score, train_csv
    rows = "".join(f"{i},{'ab'[i % 2]},{i % 7}.5,{3 * (i % 7) + (i % 2)}\n" for i in range(120))
    path = write(tmp_dir, "ok.csv", "id,kind,size,price\n" + rows)
    result = train_csv(spark, path, "price", ["id"], features=["size", "kind"], algorithm="ridge", expert=True)
    assert result.metrics.first()["r2"] > 0.9
    assert {r["column"] for r in result.profile.collect()} == {"size", "price"}
    model = result.save(os.path.join(tmp_dir, "models"))
    scored, problems = score(spark, model, spark.createDataFrame([(1, 2.0)], "id int, size double"), ["id"])
    assert scored is None and [r["problem"] for r in problems.collect() if r["feature"] == "kind"] == ["missing_column"]
    for text, found in (("id,,size\n1,a,2\n", "header"), ("id,kind\n1,a\n2\n3,b,c,d\n4,x\n", "malformed"), ("id,kind\n", "empty"),
                        ("id,kind\n1,#N/A\n2,b\n", "missing"), ("id,kind\n1,a\n2,7\n", "mix")):
        with pytest.raises(Q.QualityError, match=found):
            checked_csv(spark, write(tmp_dir, f"{found}.csv", text))


def test_grid_search_is_registered_over_all_models(monkeypatch):
    from types import SimpleNamespace

    from estima.operators.tuning import DEFAULT_GRIDS, _points
    from estima.plans import catalog, catalog_models
    seen = {}

    def search(df, features, target, key_cols, models=tuple(DEFAULT_GRIDS), **more):
        seen.update(features=features, points=sum(len(_points(DEFAULT_GRIDS[m])) for m in models), more=more)
        return None, None

    monkeypatch.setattr(catalog_models, "grid_search", search)
    monkeypatch.setattr(catalog_models, "lineitem_frame", lambda *a: SimpleNamespace(where=lambda c: None))
    monkeypatch.setattr(catalog_models, "rsig", lambda *a: None)
    monkeypatch.setattr(catalog_models, "F", SimpleNamespace(col=lambda c: True))
    catalog.QUERIES["grid_search_models"](None, "")
    assert len(seen["features"]) == 6 and seen["points"] == 8 and not seen["more"]


def test_importance_of_several_features_sums_to_one(spark):
    from estima.plans import catalog
    got = {r["feature"]: r["importance"] for r in catalog.QUERIES["permutation_importance_features"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 6 and abs(sum(got.values()) - 1) < 1e-4 and max(got, key=got.get) == "l_extendedprice"
