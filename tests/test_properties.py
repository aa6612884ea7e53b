"""Property tests: exact quantiles and entropy against numpy on random data."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from estima.operators import profile as P

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                  min_size=1, max_size=120)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, p=st.sampled_from([0.0, 0.1, 0.5, 0.77, 1.0]), limit=st.sampled_from([0, 7, 50_000]),
       groups=st.integers(1, 3))
def test_quantiles_match_numpy(spark, vals, p, limit, groups):
    rows = [(i % groups, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: r["value"] for r in P.order_statistics(df, ["x"], (p,), groups=["g"], buckets=8,
                                                          collect_limit=limit).collect()}
    for g in range(min(groups, len(vals))):
        xs = np.array([v for gg, v in rows if gg == g])
        assert got[g] == pytest.approx(np.percentile(xs, p * 100), rel=1e-9, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.lists(st.sampled_from(["a", "b", "c", "dd", "e_f"]), min_size=1, max_size=80))
def test_entropy_matches_numpy(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = P.entropy(df, ["w"]).first()["entropy"]
    _, counts = np.unique(words, return_counts=True)
    p = counts / counts.sum()
    assert got == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-12)
