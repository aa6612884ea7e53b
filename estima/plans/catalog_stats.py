"""Registered queries: column statistics, screening, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from estima.operators import profile as P
from estima.plans import sqltext as S
from estima.plans.catalog import LI_NUM, q, rsig
from estima.plans.frames import lineitem_frame
from estima.sources.tables import scan_table


def _profile_sql(cols, groups=(), table="lineitem"):
    g = "".join(f"{x}, " for x in groups)
    gb = f" GROUP BY {', '.join(groups)}" if groups else ""
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {g}'{c}' AS column, count({x}) AS n, min({x}) AS min, max({x}) AS max, "
            f"round(avg({x}), 4) AS mean, round(median({x}), 4) AS median, round(stddev_samp({x}), 4) AS std, "
            f"round(CASE WHEN count({x}) < 3 THEN NULL WHEN var_pop({x}) = 0 THEN 0e0 ELSE skewness({x}) END, 4) AS skewness, "
            f"round(CASE WHEN count({x}) < 4 THEN NULL WHEN var_pop({x}) = 0 THEN 0e0 ELSE kurtosis({x}) END, 4) AS kurtosis "
            f"FROM {table}{gb}")
    return "\nUNION ALL\n".join(parts)


_LI_ALL_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_NUM]


@q("profile_numeric", _profile_sql(_LI_ALL_NUM))
def profile_numeric_q(spark, base):
    return P.profile_numeric(scan_table(spark, base, "lineitem"))


@q("grouped_profile", _profile_sql(LI_NUM, ("l_returnflag", "l_linestatus")))
def grouped_profile_q(spark, base):
    li = scan_table(spark, base, "lineitem", ["l_returnflag", "l_linestatus", *LI_NUM])
    return P.grouped_profile(li, ["l_returnflag", "l_linestatus"], LI_NUM)


@q("skew_kurt", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {S.rs(f'CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0e0 ELSE skewness({c}) END')} AS skewness, "
    f"{S.rs(f'CASE WHEN count({c}) < 4 THEN NULL WHEN var_pop({c}) = 0 THEN 0e0 ELSE kurtosis({c}) END')} AS kurtosis FROM lineitem"
    for c in LI_NUM))
def skew_kurt_q(spark, base):
    return rsig(P.skew_kurt(scan_table(spark, base, "lineitem"), LI_NUM), "skewness", "kurtosis")


_NV_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_linestatus", "l_shipdate", "is_returned"]


@q("no_variation", "WITH li AS (SELECT *, l_returnflag = 'R' AS is_returned FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{c}' AS column, {i} AS position FROM li GROUP BY l_returnflag "
    f"HAVING count({c}) > 0 AND min({c}) = max({c})"
    for i, c in enumerate(_NV_COLS, start=1) if c != "l_returnflag"))
def no_variation_q(spark, base):
    li = scan_table(spark, base, "lineitem").withColumn("is_returned", F.col("l_returnflag") == "R")
    cols = [c for c in li.columns if c != "l_returnflag"]
    res = P.no_variation(li.select("l_returnflag", *cols), cols, groups=["l_returnflag"])
    # positions relative to the screened columns (group column excluded)
    pos = {c: i + 1 for i, c in enumerate(cols)}
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    return res.select("l_returnflag", "column", m[F.col("column")].alias("position"))


_CV_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {S.rs(f'avg({c})')} AS mean, {S.rs(f'stddev_samp({c})')} AS std, "
    f"{S.rs(f'stddev_samp({c}) / avg({c})')} AS cv, stddev_samp({c}) / avg({c}) > 1 AS flagged FROM documents"
    for c in ["doc_id", "n_chars"])


@q("coeff_variation", _CV_SQL)
def coeff_variation_q(spark, base):
    d = scan_table(spark, base, "documents", ["doc_id", "n_chars"])
    return rsig(P.coeff_variation(d), "mean", "std", "cv")


_UR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, "
    f"{S.rs(f'count(DISTINCT {c}) / count(*)')} AS ratio, count(DISTINCT {c}) / count(*) > 0.9 AS flagged FROM documents"
    for c in ["text", "lang", "source"])


@q("unique_ratio", _UR_SQL)
def unique_ratio_q(spark, base):
    d = scan_table(spark, base, "documents", ["text", "lang", "source"])
    return rsig(P.unique_ratio(d), "ratio")


@q("unique_ratio_approx", _UR_SQL)
def unique_ratio_approx_q(spark, base):
    d = scan_table(spark, base, "documents", ["text", "lang", "source"])
    return rsig(P.unique_ratio(d, exact=False), "ratio").drop("exact")


@q("high_variation", f"""
SELECT 'n_chars' AS column, 'coeff_variation' AS rule, {S.rs('stddev_samp(n_chars) / avg(n_chars)')} AS value
FROM documents HAVING stddev_samp(n_chars) / avg(n_chars) > 1
UNION ALL
SELECT 'doc_id', 'coeff_variation', {S.rs('stddev_samp(doc_id) / avg(doc_id)')}
FROM documents HAVING stddev_samp(doc_id) / avg(doc_id) > 1
UNION ALL
SELECT c, 'unique_ratio', {S.rs('r')} FROM (
  SELECT 'text' AS c, count(DISTINCT text) / count(*) AS r FROM documents
  UNION ALL SELECT 'lang', count(DISTINCT lang) / count(*) FROM documents
  UNION ALL SELECT 'source', count(DISTINCT source) / count(*) FROM documents) WHERE r > 0.9""")
def high_variation_q(spark, base):
    d = scan_table(spark, base, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return rsig(P.high_variation(d), "value")


@q("filter_threshold", f"""
SELECT c AS column, {S.rs('r')} AS ratio FROM (
  SELECT 'text' AS c, count(DISTINCT text) / count(*) AS r FROM documents
  UNION ALL SELECT 'lang', count(DISTINCT lang) / count(*) FROM documents
  UNION ALL SELECT 'source', count(DISTINCT source) / count(*) FROM documents) WHERE r > 0.9""")
def filter_threshold_q(spark, base):
    d = scan_table(spark, base, "documents", ["text", "lang", "source"])
    ur = P.unique_ratio(d)
    return rsig(P.filter_threshold(ur, "ratio", ">", 0.9).select("column", "ratio"), "ratio")


_ENT_COLS = [("part", "p_name"), ("part", "p_brand"), ("part", "p_type")]


@q("entropy", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {S.rs('-sum(p * log2(p))')} AS entropy FROM "
    f"(SELECT count(*) / sum(count(*)) OVER () AS p FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"
    for t, c in _ENT_COLS))
def entropy_q(spark, base):
    p = scan_table(spark, base, "part", [c for _, c in _ENT_COLS])
    return rsig(P.entropy(p), "entropy")


@q("value_frequencies", f"""
SELECT o_orderpriority AS value, count(*) AS count, {S.rs('count(*) / sum(count(*)) OVER ()')} AS frequency
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def value_frequencies_q(spark, base):
    return rsig(P.value_frequencies(scan_table(spark, base, "orders"), "o_orderpriority"), "frequency")


@q("target_range", "WITH " + S.LM + " SELECT min(charge) AS min, max(charge) AS max FROM lm")
def target_range_q(spark, base):
    return P.target_range(lineitem_frame(spark, base), "charge")


@q("order_statistics", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {p}e0 AS prob, {S.rs(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS value FROM lineitem"
    for c in LI_NUM for p in (0.1, 0.25, 0.5, 0.75, 0.9)))
def order_statistics_q(spark, base):
    li = scan_table(spark, base, "lineitem", LI_NUM)
    return rsig(P.order_statistics(li, LI_NUM, (0.1, 0.25, 0.5, 0.75, 0.9)), "value")
