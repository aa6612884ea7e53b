import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estima.operators import profile as P


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "weight": rng.integers(2, 36, n),
        "price": np.round(rng.gamma(4.0, 0.35, n), 2),
        "region": rng.choice(["North", "South", "East", "West"], n),
        "supplier": ["Acme"] * n,
        "size": rng.choice(["Small", "Standard", "Large"], n, p=[0.2, 0.5, 0.3]),
    })
    return pdf, spark.createDataFrame(pdf)


def test_profile_numeric_matches_pandas(parts):
    pdf, df = parts
    got = {r["column"]: r for r in P.profile_numeric(df, ["weight", "price"], decimals=None).collect()}
    for c in ["weight", "price"]:
        s = pdf[c].astype(float)
        r = got[c]
        assert r["n"] == len(s)
        assert r["min"] == s.min() and r["max"] == s.max()
        assert r["mean"] == pytest.approx(s.mean(), rel=1e-12)
        assert r["median"] == pytest.approx(s.median(), rel=1e-12)
        assert r["std"] == pytest.approx(s.std(), rel=1e-10)
        assert r["skewness"] == pytest.approx(s.skew(), rel=1e-8)
        assert r["kurtosis"] == pytest.approx(s.kurt(), rel=1e-8)


def test_profile_small_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (None, 5.0, None), (None, 5.0, None)],
                               "a double, c double, one double")
    got = {r["column"]: r for r in P.profile_numeric(df, ["a", "c", "one"], decimals=None).collect()}
    assert got["a"]["skewness"] is None and got["a"]["kurtosis"] is None  # n < 3 / n < 4
    assert got["c"]["skewness"] == 0.0 and got["c"]["kurtosis"] == 0.0 and got["c"]["std"] == 0.0
    assert got["one"]["median"] == 1.0 and got["one"]["std"] is None


@pytest.mark.parametrize("probs,limit", [((0.5,), 50_000), ((0.1, 0.25, 0.75, 0.9), 50_000),
                                         ((0.5,), 10), ((0.1, 0.25, 0.75, 0.9), 90)])
def test_order_statistics_grouped_matches_numpy(parts, probs, limit):
    pdf, df = parts
    # limit 10: every group takes the refinement path; 90: a mix of both paths
    got = P.order_statistics(df, ["price", "weight"], probs, groups=["region"], collect_limit=limit).collect()
    assert len(got) == 4 * 2 * len(probs)
    for r in got:
        s = pdf.loc[pdf.region == r["region"], r["column"]].astype(float).values
        assert r["value"] == pytest.approx(np.percentile(s, r["prob"] * 100), rel=1e-12)


@pytest.mark.parametrize("limit", [0, 50_000])
def test_order_statistics_of_any_range(spark, limit):
    inf = float("inf")
    rng = np.random.default_rng(2)
    spread = (rng.choice([-1.0, 1.0], 2001) * 10.0 ** rng.uniform(-300, 300, 2001)).tolist()
    ends = [-inf] * 3 + rng.normal(size=501).tolist() + [inf] * 4 + [5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308]
    df = spark.createDataFrame([("a", v) for v in spread] + [("b", v) for v in ends] + [("c", v) for v in [inf] * 5 + [1.0]], "g string, `x.y` double")
    got = {(r["g"], r["prob"]): r["value"] for r in P.order_statistics(df, ["x.y"], (0.0, 0.3, 0.5, 1.0), ["g"], buckets=16, collect_limit=limit).collect()}
    for g, vals in (("a", spread), ("b", ends), ("c", [inf] * 5 + [1.0])):
        ordered = sorted(vals)
        for p in (0.0, 0.3, 0.5, 1.0):
            h = (len(vals) - 1) * p
            lo, hi = ordered[int(h)], ordered[min(int(h) + 1, len(vals) - 1)]
            want = lo if lo == hi else lo + (hi - lo) * (h - int(h))
            if want == want and (limit == 0 or abs(want) != inf):
                assert got[(g, p)] == pytest.approx(want, rel=1e-9, abs=0), (g, p)


def test_order_statistics_heavy_ties_and_tiny_buckets(spark):
    vals = [0.0] * 500 + [1e-300, 2e-300] + [1.0] * 300 + list(np.linspace(1, 2, 99))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for p in (0.3, 0.5, 0.56, 0.9):
        got = P.order_statistics(df, ["x"], (p,), buckets=4, collect_limit=0).first()["value"]
        assert got == pytest.approx(np.percentile(vals, p * 100), rel=1e-12, abs=1e-310)


def test_no_variation_edge_cases(spark):
    rows = [(None, float("nan"), 3.0, "a", 1), (None, float("nan"), None, "b", 1)]
    df = spark.createDataFrame(rows, "allnull double, allnan double, onevalue double, txt string, const int")
    flagged = {r["column"] for r in P.no_variation(df).collect()}
    assert flagged == {"onevalue", "const"}


def test_no_variation_adding_constant_adds_one_flag(parts):
    pdf, df = parts
    before = {r["column"] for r in P.no_variation(df).collect()}
    after = {r["column"] for r in P.no_variation(df.withColumn("k", F.lit(7))).collect()}
    assert before == {"supplier"} and after == before | {"k"}


def test_coeff_variation_rules(spark):
    df = spark.createDataFrame([(-1.0, 1.0, 0.1, 5.0), (1.0, -3.0, 0.1, None), (0.0, -4.0, 3.0, None)],
                               "zero double, neg double, high double, single double")
    got = {r["column"]: r for r in P.coeff_variation(df).collect()}
    assert got["zero"]["cv"] == math.inf and got["zero"]["flagged"]
    assert got["neg"]["cv"] < 0 and not got["neg"]["flagged"]
    assert got["high"]["flagged"]
    assert "single" not in got  # undefined std -> dropped


def test_unique_ratio_exact_and_approx(parts):
    pdf, df = parts
    ex = {r["column"]: r["ratio"] for r in P.unique_ratio(df, ["region", "supplier", "size"]).collect()}
    for c in ["region", "supplier", "size"]:
        assert ex[c] == pytest.approx(pdf[c].nunique() / len(pdf))
    wide = (df.withColumn("key", F.col("id").cast("string"))
            .withColumn("near", (F.col("id") % 370).cast("string")))  # 370 / 400 = 0.925
    ap = {r["column"]: r for r in P.unique_ratio(wide, ["region", "key", "near"], exact=False).collect()}
    assert not ap["key"]["exact"] and ap["key"]["flagged"]  # far above the threshold: estimate suffices
    assert ap["near"]["exact"] and ap["near"]["ratio"] == pytest.approx(0.925) and ap["near"]["flagged"]
    assert not ap["region"]["exact"] and not ap["region"]["flagged"]


def test_entropy_and_frequencies(parts):
    pdf, df = parts
    got = {r["column"]: r["entropy"] for r in P.entropy(df, ["region", "size", "supplier"]).collect()}
    for c in ["region", "size", "supplier"]:
        p = pdf[c].value_counts(normalize=True).values
        assert got[c] == pytest.approx(-np.sum(p * np.log2(p)), abs=1e-12)
    fr = {r["value"]: r["frequency"] for r in P.value_frequencies(df, "size").collect()}
    exp = pdf["size"].value_counts(normalize=True).to_dict()
    assert fr == pytest.approx(exp)


def test_high_variation_union(spark):
    rows = [(i, float(i % 7 == 0) * 100 + 0.01, f"id{i}", "x" if i % 2 else "y") for i in range(50)]
    df = spark.createDataFrame(rows, "i long, spiky double, name string, two string")
    got = {(r["column"], r["rule"]) for r in P.high_variation(df).collect()}
    assert got == {("spiky", "coeff_variation"), ("name", "unique_ratio")}


def test_profile_keeps_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, e double")
    got = {r["column"]: r for r in P.profile_numeric(df).collect()}
    assert got["e"]["n"] == 0 and got["e"]["mean"] is None and got["a"]["n"] == 2


@pytest.mark.parametrize("limit", [50_000, 3])
def test_null_group_is_a_group(spark, limit):
    rows = [(None, 1.0), (None, 3.0), (None, 10.0), ("a", 2.0), ("a", 4.0), ("a", 5.0), ("a", 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["value"] for r in P.order_statistics(df, ["x"], (0.5,), groups=["g"], collect_limit=limit).collect()}
    assert got == {None: 3.0, "a": 4.5}
    prof = {r["g"]: r["median"] for r in P.profile_numeric(df, ["x"], groups=["g"]).collect()}
    assert prof == {None: 3.0, "a": 4.5}


def test_values_of_large_groups_do_not_meet_in_one_task(spark):
    """Whatever the size of the keys is estimated as, the values are not shuffled by their column's name."""
    from estima.operators import profile
    rows = spark.range(2000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
    held, real = [], profile.join_on_keys

    def noted(left, right, keys, how="inner"):
        out = real(left, right, keys, how)
        if left.columns == ["column", "value"]:
            held.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    profile.join_on_keys = noted
    try:
        got = {r["column"]: r["value"] for r in profile.order_statistics(rows, ["a", "b"], (0.5,), collect_limit=100).collect()}
    finally:
        profile.join_on_keys = real
    assert got == {"a": 999.5, "b": 3.0}
    assert held and all("strategy=broadcast" in p for p in held)
