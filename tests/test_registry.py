"""The model store: versions, half-finished saves, pruning; places a sink must not touch."""

import os

import pytest

from estima.operators.models import pipeline_fit
from estima.sources.registry import complete_versions, model_load, model_metadata, model_save, prune_versions, score_sink


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([(float(i), float(i) * k) for i in range(6) for k in (2,)], "x double, y double")
    return df, [pipeline_fit(df, ["x"], "y", "ridge", alpha=a) for a in (0.1, 50.0)]


def test_a_save_that_dies_leaves_the_former_version(spark, tmp_dir, models):
    df, (first, second) = models
    path = os.path.join(tmp_dir, "store", "m")
    with pytest.raises(FileNotFoundError):
        model_load(spark, path)
    model_save(first, model_metadata(spark, "ridge", ["x"], "y", 0.5), path)
    # dies after the model, before its metadata and its mark
    second.write().save(f"{path}/versions/99999999999999999999-dead/model")
    got = model_load(spark, path)
    assert got.metadata["r2"] == "0.5"
    want = [r["prediction"] for r in first.transform(df).collect()]
    assert [r["prediction"] for r in got.model.transform(df).collect()] == want
    model_save(second, model_metadata(spark, "ridge", ["x"], "y", 0.25), path)
    assert model_load(spark, path).metadata["r2"] == "0.25" and len(complete_versions(spark, path)) == 2
    prune_versions(spark, path)
    assert len(complete_versions(spark, path)) == 1 and model_load(spark, path).metadata["r2"] == "0.25"


def test_a_sink_never_touches_its_input(spark, tmp_dir, models):
    df = models[0]
    source = os.path.join(tmp_dir, "rows", "in")
    df.write.parquet(source)
    for other in (source, source + "/", os.path.join(tmp_dir, "rows", ".", "in"), os.path.join(tmp_dir, "rows", "x", "..", "in"), "file:" + source,
                  "file://" + source, os.path.join(tmp_dir, "rows"), os.path.join(source, "part"), os.path.relpath(source)):
        with pytest.raises(ValueError, match="one place"):
            score_sink(df, other, source_path=source)
    assert spark.read.parquet(source).count() == 6
    score_sink(spark.read.parquet(source), os.path.join(tmp_dir, "rows", "in2"), source_path=source)
    assert spark.read.parquet(os.path.join(tmp_dir, "rows", "in2")).count() == 6
