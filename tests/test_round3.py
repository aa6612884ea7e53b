"""Findings of round 3: what grows with the table is handed over, looked up and moved cheaply."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from estima.operators import ridge


def test_narrow_vectors_go_to_python_as_arrays(spark):
    rows = [(0, Vectors.dense([1.0, 0.0, 3.0])), (1, None), (2, Vectors.sparse(3, [1], [5.0]))]
    df = spark.createDataFrame(rows, ["i", "x"])
    assert df.select(ridge.handed("x", 3).alias("x")).schema["x"].dataType.simpleString() == "array<double>"
    assert df.select(ridge.handed("x", ridge.MOST_DENSE + 1).alias("x")).schema["x"].dataType.simpleString() == "vector"

    def seen(slots):
        def run(batches):
            for b in batches:
                row, slot, value = ridge.entries(b.column("x"))
                i = np.asarray(b.column("i"))[row]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(slot.astype(np.int64)), pa.array(value)], ["i", "slot", "value"])
        got = df.coalesce(1).select("i", ridge.handed("x", slots).alias("x")).mapInArrow(run, "i long, slot long, value double")
        return {(r["i"], r["slot"], r["value"]) for r in got.where(F.col("value") != 0).collect()}

    assert seen(3) == seen(ridge.MOST_DENSE + 1) == {(0, 0, 1.0), (0, 2, 3.0), (2, 1, 5.0)}


def test_bijections_of_whole_batches_are_the_ones_of_the_expression(spark):
    from estima.functions.bijection import keys, permuted, permuted_each
    for n in (1, 7, 4099):
        each = [keys(f"x|0|{r}") for r in range(3)]
        rows = spark.range(n).select(F.array(*[permuted(F.col("id"), n, k) for k in each]).alias("a"), permuted_each(F.col("id"), n, each).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)


def test_many_quantiles_meet_one_bracket_a_value(spark):
    from estima.operators import profile as P
    rng = np.random.default_rng(3)
    near = np.nextafter(8.0, 0) - np.arange(40) * 2.0**-50  # where the logarithm rounds to the next whole number
    x = np.concatenate([rng.normal(0, 1e4, 3000), 1e9 + rng.random(2000), -near, near, [5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, 8.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [i / 256 for i in range(257)]
    for buckets in (1024, 6):
        got = {r["prob"]: r["value"] for r in P.order_statistics(df, ["x"], probs, buckets=buckets, collect_limit=0).collect()}
        assert np.array([got[p] for p in probs]) == pytest.approx(np.quantile(x, probs), rel=1e-12)
    # the bracket is looked up by equality
    v = F.col("x")
    cells = df.select("x", P._monotone_code(v).alias("c"), *[P._cell(v, b).alias(f"b{b}") for b in (10, 20, 54)]).collect()
    order = sorted(cells, key=lambda r: r["x"])
    for b in (10, 20, 54):
        codes = [(r["c"], r[f"b{b}"]) for r in order]
        assert codes == sorted(codes)
    assert all(p["x"] == q["x"] for p, q in zip(order, order[1:]) if (p["c"], p["b54"]) == (q["c"], q["b54"]))
