"""Keyed bijections: every rank is met once, keys differ, the spread is even."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estima.functions.bijection import keys, permuted, sides


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 4099])
def test_every_rank_is_met_once(spark, n):
    a, b = sides(n)
    assert a * b >= n and a * b - n < a
    rows = spark.range(n).select(permuted(F.col("id"), n, keys("x|0|1")).alias("p"),
                                 permuted(F.col("id"), n, F.array(*[F.lit(k).cast("long") for k in keys("x|0|2")])).alias("q")).collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(n))
    if n > 90:
        p, q = np.array([r["p"] for r in rows]), np.array([r["q"] for r in rows])
        assert (p == q).mean() < 0.1 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.35 and abs(np.corrcoef(p, q)[0, 1]) < 0.35
