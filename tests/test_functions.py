import math

import numpy as np
import pytest

from estima.functions import round_sig, t_test_p_value
from estima.functions.hashing import hash_bucket


def test_p_value_known_points(spark):
    # reference values of the two-sided Student-t tail (incomplete beta)
    rows = [(math.sqrt(2.989501344416376), 398.0, 0.0845814103), (2.0, 2.0, 0.1835034191),
            (12.706204736, 1.0, 0.05), (1.96, 1e6, 0.0499960676), (5.0, 100.0, 2.4501734e-06), (0.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "t double, d double, want double")
    got = df.select("want", t_test_p_value("t", "d").alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(r["want"], rel=1e-6, abs=1e-9)


def test_p_value_null_cases(spark):
    df = spark.createDataFrame([(None, 5.0), (1.0, 0.0), (1.0, None)], "t double, d double")
    assert [r[0] for r in df.select(t_test_p_value("t", "d")).collect()] == [None, None, None]


def test_round_sig(spark):
    vals = [123456.789, 0.000123456789, -9.87654321e-7, 0.0, None, 1e20, 2.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_sig("x", 6)).collect()]
    assert got == [123457.0, 0.000123457, -9.87654e-7, 0.0, None, 1e20, 2.5]


def test_hash_bucket_is_stable_under_repartition(spark):
    df = spark.range(2000).withColumn("b", hash_bucket(["id"], 100))
    a = {r["id"]: r["b"] for r in df.collect()}
    b = {r["id"]: r["b"] for r in df.repartition(7).collect()}
    assert a == b
    share = np.mean([v < 20 for v in a.values()])
    assert 0.15 < share < 0.25
