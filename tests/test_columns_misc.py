import pytest
from pyspark.sql import functions as F

from estima.operators import columns as C
from estima.operators import importance as I
from estima.operators import profile as P


def test_schema_report_and_roles(spark):
    df = spark.createDataFrame([(1, 2.5, "a", True, None)], "i int, d double, s string, b boolean, t timestamp")
    labels = {r.column: r.type for r in C.schema_report(df).collect()}
    assert labels == {"i": "numerical: integer", "d": "numerical: float", "s": "text", "b": "boolean",
                      "t": "timestamp"}
    roles = {r.column: r.role for r in C.column_roles(df).collect()}
    assert roles == {"i": "numeric", "d": "numeric", "s": "categorical", "b": "categorical", "t": "ignored"}
    assert C.split_roles(df) == (["i", "d"], ["s", "b"])


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, target int")
    assert C.drop_columns(df, ["a", "target"], protect=["target"]).columns == ["b", "target"]
    assert C.rename_columns(df, {"a": "x"}).columns == ["x", "b", "target"]
    assert C.project_columns(df, ["b"]).columns == ["b"]
    with pytest.raises(ValueError):
        C.project_columns(df, ["nope"])
    assert C.parse_feature_list(" Weight, Size ,,Color") == ["Weight", "Size", "Color"]


def test_frequencies_ignore_nulls_and_thresholds(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    fr = {r.value: (r["count"], r.frequency) for r in P.value_frequencies(df, "v").collect()}
    assert fr == {"a": (2, pytest.approx(2 / 3)), "b": (1, pytest.approx(1 / 3))}
    stats = spark.createDataFrame([("x", 0.5), ("y", 1.5), ("z", 1.0)], "column string, cv double")
    assert {r.column for r in P.filter_threshold(stats, "cv", ">", 1.0).collect()} == {"y"}
    assert {r.column for r in P.filter_threshold(stats, "cv", "<=", 1.0).collect()} == {"x", "z"}


def test_importance_formatting_and_ranking(spark):
    imp = spark.createDataFrame([("w", 0.625), ("s", 0.25), ("c", 0.125)], "feature string, importance double")
    table = {r.feature: r.importance for r in I.importance_table(imp).collect()}
    assert table == {"w": "62.5%", "s": "25.0%", "c": "12.5%"}
    assert [r.feature for r in I.top_k_features(imp, 2).collect()] == ["w", "s"]
    share = {r.feature: r.importance_pct for r in I.importance_share(imp).collect()}
    assert share == {"w": 62.5, "s": 25.0, "c": 12.5}
    dup = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "feature string, importance double")
    assert I.dedupe(dup, ["feature", "importance"]).count() == 2
    assert sorted(r.feature for r in I.unique_names(dup).collect()) == ["a", "b"]


def test_score_plan_writes_output(spark, tmp_dir):
    from estima.plans import score, train
    rows = [(i, float(i % 11), ["A", "B"][i % 2], 3.0 + 0.5 * (i % 11) + (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, g string, y double")
    res = train(df, "y", ["id"], features=["x", "g"], algorithm="ridge", expert=True)
    path = res.save(tmp_dir)
    res.release()
    new = spark.createDataFrame([(1000, 2.0, "A"), (1001, 3.0, "Z")], "id long, x double, g string")
    scored, problems = score(spark, path, new, key_cols=["id"], out_path=f"{tmp_dir}/out")
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 2
    assert [(r.id, r.problem) for r in problems.collect()] == [(1001, "unseen_category")]
    assert scored.where(F.col("prediction").isNull()).count() == 0
