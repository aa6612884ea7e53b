"""Registered queries: chart data of the model report."""

from __future__ import annotations

from pyspark.sql import functions as F

from estima.operators import chartdata as D
from estima.plans import sqltext as S
from estima.plans.catalog import LI_KEY_SQL, LI_NUM, q, rsig
from estima.plans.frames import LI_KEY, lineitem_predictions
from estima.sources.tables import scan_table


def _preds(spark, base):
    return lineitem_predictions(spark, base)


@q("residuals", "WITH " + S.RIDGE_LI + f" SELECT {LI_KEY_SQL}, round(charge - prediction, 4) AS residual FROM al")
def residuals_q(spark, base):
    # places, not digits: a residual near 0 is what cancellation leaves
    return D.residuals(_preds(spark, base), "charge").select(*LI_KEY, F.round("residual", 4).alias("residual"))


def _hist_sql(src: str, value: str, bins: str, column: str) -> str:
    """Histogram with every bin; ``bins`` is an SQL expression over ``r``."""
    return f"""r AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                    CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(*) AS n
             FROM (SELECT {value} AS v FROM {src}) WHERE v IS NOT NULL AND NOT isnan(v)),
rb AS (SELECT lo, hi, CAST({bins} AS INTEGER) AS bins FROM r),
c AS (SELECT CAST(least(floor((v - lo) * (bins / (hi - lo))), bins - 1) AS INTEGER) AS bin, count(*) AS cnt
      FROM (SELECT {value} AS v FROM {src}), rb WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1),
g AS (SELECT lo, hi, bins, CAST(b AS INTEGER) AS bin FROM rb, range(CAST(bins AS BIGINT)) t(b))
SELECT '{column}' AS column, g.bin, {S.rs('lo + g.bin * ((hi - lo) / bins)')} AS lo,
       {S.rs('lo + (g.bin + 1) * ((hi - lo) / bins)')} AS hi, coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c ON g.bin = c.bin"""


@q("histogram_30", "\nUNION ALL\n".join(
    f"(WITH {_hist_sql('lineitem', c, '30', c)})" for c in LI_NUM))
def histogram_30_q(spark, base):
    return rsig(D.histogram(scan_table(spark, base, "lineitem", LI_NUM), LI_NUM, 30), "lo", "hi")


_CHART_TEXT = ["l_returnflag", "l_linestatus"]


@q("column_charts", "\nUNION ALL\n".join(
    f"(SELECT \"column\", CAST(NULL AS VARCHAR) AS value, bin, lo, hi, count FROM (WITH {_hist_sql('lineitem', c, '30', c)}))" for c in LI_NUM)
    + "".join(f"\nUNION ALL SELECT '{c}', {c}, -1, 0e0, 0e0, count(*) FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CHART_TEXT))
def column_charts_q(spark, base):
    """Every column's chart: bins of numbers, value counts of texts."""
    columns = [*LI_NUM, *_CHART_TEXT]
    out = D.column_charts(scan_table(spark, base, "lineitem", columns), columns)
    return rsig(out.fillna({"bin": -1, "lo": 0.0, "hi": 0.0}), "lo", "hi")


@q("residual_hist_20", "WITH " + S.RIDGE_LI + ", " + _hist_sql("al", "charge - prediction", "20", "residual"))
def residual_hist_20_q(spark, base):
    return rsig(D.residual_hist(_preds(spark, base), "charge", bins=20), "lo", "hi")


_AUTO_BINS = """(SELECT CASE WHEN n = 0 OR hi = lo THEN 1
   ELSE ceil((mx - mn) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) END
   FROM (SELECT count(v) AS n, min(v) AS mn, max(v) AS mx, min(v) AS lo, max(v) AS hi,
                (max(v) - min(v)) / (log2(count(v)) + 1e0) AS sturges,
                2e0 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(count(v), -1e0 / 3e0) AS fd
         FROM (SELECT charge - prediction AS v FROM al)))"""


@q("residual_hist_auto", "WITH " + S.RIDGE_LI + ", " + _hist_sql("al", "charge - prediction", _AUTO_BINS, "residual"))
def residual_hist_auto_q(spark, base):
    return rsig(D.residual_hist_auto(_preds(spark, base), "charge"), "lo", "hi")


_KDE = "WITH " + S.RIDGE_LI + f""",
v AS (SELECT charge - prediction AS v FROM al),
ks AS (SELECT count(*) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2e0) AS bw FROM v),
d AS (SELECT CAST(p AS INTEGER) AS point, mn + p * ((mx - mn) / 199) AS x, n, mn, mx,
             sum(exp(-0.5e0 * ((mn + p * ((mx - mn) / 199) - v) / bw) * ((mn + p * ((mx - mn) / 199) - v) / bw)))
             / (n * bw * sqrt(2 * pi())) AS density
      FROM v, ks, range(200) t(p) GROUP BY p, n, bw, mn, mx)
SELECT point, {S.rs('x')} AS x, {S.rs('density', 4)} AS density, {S.rs('density * n * ((mx - mn) / 20)', 4)} AS count FROM d"""


@q("residual_density", _KDE)
def residual_density_q(spark, base):
    """Against the plain sum over all rows, without bins."""
    return rsig(rsig(D.residual_density(_preds(spark, base), "charge"), "x"), "density", "count", digits=4)


@q("residual_vs_predicted", "WITH " + S.RIDGE_LI + f""",
r AS (SELECT *, charge - prediction AS residual FROM al),
ln AS (SELECT regr_slope(residual, prediction) AS b, regr_intercept(residual, prediction) AS a FROM r)
SELECT {LI_KEY_SQL}, {S.rs('prediction')} AS prediction, round(residual, 4) AS residual,
       round(a + b * prediction, 4) AS fitted, round(residual - (a + b * prediction), 4) AS detrended FROM r, ln""")
def residual_vs_predicted_q(spark, base):
    out = D.residual_vs_predicted(_preds(spark, base), "charge", LI_KEY)
    return rsig(out, "prediction").withColumns({c: F.round(c, 4) for c in ("residual", "fitted", "detrended")})


def _bin2d_sql(src: str, x: str, y: str, bins: int = 50) -> str:
    return f"""pt AS (SELECT {x} AS px, {y} AS py FROM {src}),
rg AS (SELECT CASE WHEN min(px) = max(px) THEN min(px) - 0.5 ELSE min(px) END AS xlo,
              CASE WHEN min(px) = max(px) THEN max(px) + 0.5 ELSE max(px) END AS xhi,
              CASE WHEN min(py) = max(py) THEN min(py) - 0.5 ELSE min(py) END AS ylo,
              CASE WHEN min(py) = max(py) THEN max(py) + 0.5 ELSE max(py) END AS yhi FROM pt),
cl AS (SELECT CAST(least(floor((px - xlo) * ({bins} / (xhi - xlo))), {bins - 1}) AS INTEGER) AS x_bin,
              CAST(least(floor((py - ylo) * ({bins} / (yhi - ylo))), {bins - 1}) AS INTEGER) AS y_bin, count(*) AS count
       FROM pt, rg GROUP BY 1, 2)
SELECT x_bin, y_bin, {S.rs(f'xlo + x_bin * ((xhi - xlo) / {bins})')} AS x_lo, {S.rs(f'xlo + (x_bin + 1) * ((xhi - xlo) / {bins})')} AS x_hi,
       {S.rs(f'ylo + y_bin * ((yhi - ylo) / {bins})')} AS y_lo, {S.rs(f'ylo + (y_bin + 1) * ((yhi - ylo) / {bins})')} AS y_hi, count
FROM cl, rg"""


_XY = ["x_lo", "x_hi", "y_lo", "y_hi"]


@q("actual_vs_predicted", "WITH " + S.RIDGE_LI + ", " + _bin2d_sql("al", "charge", "prediction"))
def actual_vs_predicted_q(spark, base):
    return rsig(D.actual_vs_predicted(_preds(spark, base), "charge"), *_XY)


@q("error_vs_predicted", "WITH " + S.RIDGE_LI + ", " + _bin2d_sql("al", "prediction", "charge - prediction"))
def error_vs_predicted_q(spark, base):
    return rsig(D.error_vs_predicted(_preds(spark, base), "charge"), *_XY)


@q("residual_trend")
def residual_trend_q(spark, base):
    r = D.residual_vs_predicted(_preds(spark, base), "charge", LI_KEY)
    return D.lowess_trend(r, "prediction", "detrended")


_REPORT = "\nUNION ALL\n".join([
    "SELECT 'actual_vs_predicted' AS chart, (SELECT count(*) FROM (WITH " + S.RIDGE_LI + ", "
    + _bin2d_sql("al", "charge", "prediction") + ")) AS n_rows",
    "SELECT 'target_range', CAST(1 AS BIGINT)",
    "SELECT 'residual_hist_20', CAST(20 AS BIGINT)",
    "SELECT 'residual_density', CAST(200 AS BIGINT)",
    "SELECT 'residual_vs_predicted', (SELECT count(*) FROM (WITH " + S.RIDGE_LI + " SELECT * FROM al))",
    "SELECT 'residual_trend', CAST(100 AS BIGINT)",
    "SELECT 'error_vs_predicted', (SELECT count(*) FROM (WITH " + S.RIDGE_LI + ", "
    + _bin2d_sql("al", "prediction", "charge - prediction") + "))",
])


@q("performance_report", _REPORT)
def performance_report_q(spark, base):
    charts = D.performance_report(_preds(spark, base), "charge", LI_KEY)
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("chart"), "n_rows")
             for name, t in charts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
