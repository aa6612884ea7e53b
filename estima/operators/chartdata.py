"""Chart data: the reference's plots as small aggregated tables.

A scatter of millions of points is not drawable; every chart here is a grouped
count or a curve on a fixed grid, computed by Spark, so its size is bounded by
the number of bins, not rows. Bin edges come from one min/max aggregate: joined
back by column for stacked histograms (one row per column), or fetched once as
literals (a one-row result) where a chart uses them in several places; scalar
subqueries where they are used once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estima.operators.columns import split_roles
from estima.operators.models import spread
from estima.operators.profile import order_statistics, unpivot

#: Bins that are all listed; of more bins only those with values are.
MOST_LISTED = 1_000_000


def scalars(one_row: DataFrame) -> dict:
    """Columns of a one-row aggregate as scalar subqueries (no join; Catalyst
    merges subqueries over the same aggregate into one)."""
    return {c: one_row.select(c).scalar() for c in one_row.columns}


def residuals(df: DataFrame, label: str, prediction: str = "prediction", out_col: str = "residual") -> DataFrame:
    """residual = actual - predicted, row by row (actual and predicted always from
    the same row)."""
    return df.withColumn(out_col, F.col(label).cast("double") - F.col(prediction).cast("double"))


def _ranges(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = long.groupBy(*keys).agg(F.min("value").alias("__mn"), F.max("value").alias("__mx"))
    same = F.col("__mn") == F.col("__mx")
    return r.select(*keys, F.when(same, F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("lo"),
                    F.when(same, F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("hi"))


def bin_index(value, lo, hi, bins) -> "F.Column":
    """0-based equal-width bin of ``value`` in [lo, hi] with the last bin closed."""
    nb = bins if isinstance(bins, Column) else F.lit(bins)
    return F.least(F.floor((value - lo) * (nb / (hi - lo))), nb - 1).cast("long" if isinstance(bins, int) and bins > 2**31 - 1 else "int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int | str = 30) -> DataFrame:
    """Equal-width histograms of numeric columns stacked as
    ``(column, bin, lo, hi, count)``, every bin listed (zero counts included).
    ``bins``: their number, or ``auto`` for each column's own (:func:`auto_bins`). Of more than
    ``MOST_LISTED`` bins only those with values are listed."""
    if bins == "auto":
        out = None
        for c in columns:
            one = histogram(df, [c], auto_bins(df, c))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else histogram(df, [], 1)
    long = unpivot(df, columns)
    rng = F.broadcast(_ranges(long, ["column"]))  # one row per column
    nb = F.lit(bins)
    counts = (long.join(rng, "column")
              .select("column", "lo", "hi", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
              .groupBy("column", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("count")))
    if bins <= MOST_LISTED:
        grid = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), nb - 1)).alias("bin"))
        counts = grid.join(counts.drop("lo", "hi"), ["column", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / nb
    return counts.select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
                         (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
                         F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of text columns, ``(column, value, count)``: their bars in a chart. Missing
    values are not counted; a value that most rows have is counted in part by each task."""
    return unpivot(df, columns, value_type="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def column_charts(df: DataFrame, columns: Sequence[str] | None = None, bins: int | str = 30) -> DataFrame:
    """The chart of every column as ``(column, value, bin, lo, hi, count)``: bins of numbers, values of texts."""
    numeric, text = split_roles(df, list(columns) if columns is not None else df.columns)
    bars = value_counts(df, text).select("column", "value", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("lo"),
                                         F.lit(None).cast("double").alias("hi"), "count")
    return histogram(df, numeric, bins).select("column", F.lit(None).cast("string").alias("value"), "bin", "lo", "hi", "count").unionByName(bars)


def _finite(c: str) -> Column:
    """A value that can be drawn: neither missing nor NaN nor infinite."""
    return F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))


def binned_2d(df: DataFrame, x: str, y: str, bins_x: int = 50, bins_y: int = 50) -> DataFrame:
    """Scatter as counts on a ``bins_x`` x ``bins_y`` grid:
    ``(x_bin, y_bin, x_lo, x_hi, y_lo, y_hi, count)``, non-empty cells only. A pair with a missing, NaN or infinite value is no point."""
    pts = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")) \
        .where(_finite("__x") & _finite("__y"))
    r = pts.agg(F.min("__x").alias("xmn"), F.max("__x").alias("xmx"),
                F.min("__y").alias("ymn"), F.max("__y").alias("ymx"))
    sx, sy = F.col("xmn") == F.col("xmx"), F.col("ymn") == F.col("ymx")
    r = r.select(F.when(sx, F.col("xmn") - 0.5).otherwise(F.col("xmn")).alias("xlo"),
                 F.when(sx, F.col("xmx") + 0.5).otherwise(F.col("xmx")).alias("xhi"),
                 F.when(sy, F.col("ymn") - 0.5).otherwise(F.col("ymn")).alias("ylo"),
                 F.when(sy, F.col("ymx") + 0.5).otherwise(F.col("ymx")).alias("yhi"))
    # four numbers referenced in several expressions: fetched once (one small job)
    one = r.first()
    v = {c: F.lit(one[c]) for c in ("xlo", "xhi", "ylo", "yhi")}
    cells = (pts.select(bin_index(F.col("__x"), v["xlo"], v["xhi"], bins_x).alias("x_bin"),
                        bin_index(F.col("__y"), v["ylo"], v["yhi"], bins_y).alias("y_bin"))
             .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))
    wx = (v["xhi"] - v["xlo"]) / bins_x
    wy = (v["yhi"] - v["ylo"]) / bins_y
    return cells.select(
        "x_bin", "y_bin", (v["xlo"] + F.col("x_bin") * wx).alias("x_lo"),
        (v["xlo"] + (F.col("x_bin") + 1) * wx).alias("x_hi"),
        (v["ylo"] + F.col("y_bin") * wy).alias("y_lo"),
        (v["ylo"] + (F.col("y_bin") + 1) * wy).alias("y_hi"), "count")


def actual_vs_predicted(df: DataFrame, label: str, prediction: str = "prediction", bins: int = 50) -> DataFrame:
    """Scatter of actual (x) vs predicted (y) as 2-D counts."""
    return binned_2d(df, label, prediction, bins, bins)


def error_vs_predicted(df: DataFrame, label: str, prediction: str = "prediction", bins: int = 50) -> DataFrame:
    """Scatter of residual (y) against prediction (x) as 2-D counts."""
    return binned_2d(residuals(df, label, prediction), prediction, "residual", bins, bins)


def residual_hist(df: DataFrame, label: str, prediction: str = "prediction", bins: int = 20) -> DataFrame:
    """Residual histogram with a fixed number of bins (20 in the report)."""
    return histogram(residuals(df, label, prediction), ["residual"], bins)


def auto_bins(df: DataFrame, column: str) -> int:
    """numpy's ``bins='auto'``: the narrower of Sturges and Freedman-Diaconis
    widths (Sturges when the IQR is 0); quartiles are exact."""
    x = F.when(_finite(column), F.col(column).cast("double"))
    # the search for the quartiles reads the values several times
    values = df.select(x.alias("value")).where("value is not null").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        st = values.agg(F.count("value").alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx")).first()
        n, ptp = st["n"], (st["mx"] - st["mn"]) if st["n"] else 0.0
        if not n or ptp == 0:
            return 1
        q = {r["prob"]: r["value"] for r in order_statistics(values, ["value"], (0.25, 0.75)).collect()}
    finally:
        values.unpersist()
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q[0.75] - q[0.25]) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return int(math.ceil(ptp / width))


def residual_hist_auto(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Residual histogram with the automatic bin count."""
    r = residuals(df, label, prediction)
    return histogram(r, ["residual"], auto_bins(r, "residual"))


def residual_density(df: DataFrame, label: str, prediction: str = "prediction", grid: int = 200,
                     per_bandwidth: int = 64, count_bins: int = 20) -> DataFrame:
    """Gaussian KDE of the residuals on a ``grid``-point support [min, max]
    (Scott bandwidth: std (n-1) x n^(-1/5)), evaluated over pre-bins of a
    ``per_bandwidth``-th of the bandwidth, so that they shrink with it. A bin carries its
    count, mean and variance, which leaves a relative error of third order in the bin's
    width (about 1e-6); only bins with values exist, and the cost is grid x bins. ``count`` scales the
    density to the ``count_bins`` histogram (density x n x bin width).
    Result ``(point, x, density, count)``. Missing, NaN and infinite residuals don't count; where
    all residuals are one value, all mass is there: one point with that value, an infinite density and
    all rows as its count."""
    r = residuals(df, label, prediction).select(F.col("residual").alias("value")).where(_finite("residual"))
    st = r.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx"),
               F.stddev_samp("value").alias("sd"))
    st = st.select("n", "mn", "mx", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    # four numbers used in two stages: fetched once (one small job), then literals
    one = st.first()
    if not one["bw"] or not math.isfinite(one["bw"]):
        rows = [(0, one["mn"], math.inf, float(one["n"]))] if one["n"] else []
        return df.sparkSession.createDataFrame(rows, "point int, x double, density double, count double")
    n, mn, mx, bw = (F.lit(one[c]) for c in ("n", "mn", "mx", "bw"))
    pb = (r.select(F.floor((F.col("value") - mn) / (bw / per_bandwidth)).alias("b"), "value").groupBy("b")
          .agg(F.count(F.lit(1)).alias("nb"), F.avg("value").alias("c"), F.var_pop("value").alias("s")))
    step = (mx - mn) / (grid - 1)
    pts = (pb.select("nb", "c", "s", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
           .withColumn("x", mn + F.col("point") * step))
    z = (F.col("x") - F.col("c")) / bw
    k = F.col("nb") * F.exp(-0.5 * z * z) * (1 + (z * z - 1) * F.col("s") / (2 * bw * bw))
    # the kernel is projected first: aggregates may not take subquery-dependent arguments
    dens = (pts.withColumn("__k", k).groupBy("point", "x").agg(F.sum("__k").alias("__s"))
            .select("point", "x", (F.col("__s") / (n * bw * math.sqrt(2 * math.pi))).alias("density")))
    return dens.select("point", "x", "density", (F.col("density") * n * ((mx - mn) / count_bins)).alias("count"))


def residual_vs_predicted(df: DataFrame, label: str, key_cols: Sequence[str],
                          prediction: str = "prediction") -> DataFrame:
    """Residuals against predictions with the least-squares line of residual on
    prediction removed: ``(key..., prediction, residual, fitted, detrended)``."""
    r = residuals(df, label, prediction)
    line = scalars(r.agg(F.regr_slope("residual", prediction).alias("b"),
                         F.regr_intercept("residual", prediction).alias("a")))
    fitted = line["a"] + line["b"] * F.col(prediction)
    return r.select(*key_cols, F.col(prediction).alias("prediction"), "residual", fitted.alias("fitted"),
                    (F.col("residual") - fitted).alias("detrended"))


def _bins(at: list[float], mn: float, mx: float) -> Bucketizer:
    """Bins over ``__x`` cut at the exact quantiles ``at``, so that no bin holds more than the share between two
    of the rows; a value that more rows have (several quantiles are it) is a bin of its own."""
    inner = set(at) | {math.nextafter(v, math.inf) for v, n in Counter(at).items() if n > 1}
    return Bucketizer(splits=[-math.inf, *sorted(c for c in inner if mn < c <= mx), math.inf], inputCol="__x", outputCol="b")


def lowess_trend(df: DataFrame, x: str, y: str, points: int = 100, frac: float = 2.0 / 3.0,
                 iterations: int = 3, prebins: int = 1024) -> DataFrame:
    """Robust locally weighted linear trend of ``y`` on ``x`` (the LOWESS of a
    residual plot: tricube weights over the nearest ``frac`` of the rows,
    ``iterations`` bisquare robustness passes) at ``points`` grid points.

    Work is on pre-binned sums (count, and robustness-weighted sum w, wx, wy, wxx,
    wxy per x-bin), so each local fit costs points x bins, not points x rows. Bins are
    narrower where many rows are (:func:`_bins`), so an extreme x changes no other fit.
    Each robustness pass reads the rows once for their residuals against the
    current trend (interpolated from the grid, shipped as a literal array), takes
    the exact median |residual| (distributed), and re-bins with the new weights.
    Result ``(point, x, trend)``."""
    pts = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")) \
        .where(_finite("__x") & _finite("__y"))
    # every pass of the quantiles and of the fits reads the two numbers, not the rows that they come from
    pts = spread(pts.persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return _trend(pts, points, frac, iterations, prebins)
    finally:
        pts.unpersist()


def _trend(pts: DataFrame, points: int, frac: float, iterations: int, prebins: int) -> DataFrame:
    """:func:`lowess_trend` of persisted finite pairs (``__x``, ``__y``)."""
    one = pts.agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("mn"), F.max("__x").alias("mx")).first()
    n, mn, mx = one["n"], one["mn"], one["mx"]
    spark = pts.sparkSession
    if not n:
        return spark.createDataFrame([], "point int, x double, trend double")
    step = (mx - mn) / max(points - 1, 1) if mx > mn else 0.0
    grid = [mn + i * step for i in range(points)]
    shares = [i / prebins for i in range(1, prebins)]
    base = spark.createDataFrame([("__x", n, mn, mx)], "column string, n long, lo double, hi double")
    cuts = {r["prob"]: r["value"] for r in order_statistics(pts, ["__x"], sorted({*shares, 0.5}), base=base).collect()}
    bins = _bins([cuts[p] for p in shares], mn, mx)
    # sums are taken from the median, so that they keep their digits beside an extreme x
    mid = cuts[0.5]
    z = F.col("__x") - F.lit(mid)
    robust = F.lit(1.0)
    trend = None
    for it in range(iterations + 1):
        if trend is not None:
            if trend[0] is None:
                break  # no row has weight anywhere
            arr = F.array(*[F.lit(float(t)) for t in trend])
            if step > 0:
                j = F.least(F.greatest(F.floor((F.col("__x") - F.lit(mn)) / F.lit(step)), F.lit(0)),
                            F.lit(points - 2)).cast("int")
                t0, t1 = F.element_at(arr, j + 1), F.element_at(arr, j + 2)
                yhat = t0 + (t1 - t0) * ((F.col("__x") - (F.lit(mn) + j * F.lit(step))) / F.lit(step))
            else:
                yhat = F.element_at(arr, 1)
            e = F.col("__y") - yhat
            mad = order_statistics(pts.select(F.abs(e).alias("a")), ["a"], (0.5,)).first()["value"]
            if not mad:
                break  # residuals (almost all) zero: the fit is already exact
            u = e / F.lit(6.0 * mad)
            robust = F.when(F.abs(u) < 1, F.pow(1 - u * u, 2)).otherwise(F.lit(0.0))
        binned = (bins.transform(pts).select("b", z.alias("__x"), "__y", robust.alias("__r"))
                  .groupBy("b").agg(F.count(F.lit(1)).alias("nb"), F.avg("__x").alias("cx"),
                                    F.sum("__r").alias("w"), F.sum(F.col("__r") * F.col("__x")).alias("wx"),
                                    F.sum(F.col("__r") * F.col("__y")).alias("wy"),
                                    F.sum(F.col("__r") * F.col("__x") * F.col("__x")).alias("wxx"),
                                    F.sum(F.col("__r") * F.col("__x") * F.col("__y")).alias("wxy")))
        trend = _local_fits(binned, [g - mid for g in grid], n, frac)
    return spark.createDataFrame([(i, float(g), float(t) if t is not None else None)
                                  for i, (g, t) in enumerate(zip(grid, trend))],
                                 "point int, x double, trend double")


def _local_fits(binned: DataFrame, grid: list, n: int, frac: float) -> list:
    """Weighted local linear fits at the grid points over binned sums: the
    neighbourhood radius is the distance covering ceil(frac n) rows (by count);
    weights are tricube(distance / radius) times the bins' robustness sums. Where all rows
    within the radius lie on it they count alike; a point without any weight takes
    its value from the points beside it. The grid has a fixed, small size, so the fits
    come back as a list."""
    # every bin meets every grid point: the grid is a fixed literal array, exploded per bin
    gp = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(v)).alias("g"))
                             for i, v in enumerate(grid)])).alias("__gp")
    pairs = (binned.select("*", gp).select("*", "__gp.*").drop("__gp")
             .withColumn("d", F.abs(F.col("cx") - F.col("g"))))
    w_cum = Window.partitionBy("point").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("cum", F.sum("nb").over(w_cum))
    k = math.ceil(n * frac)
    radius = pairs.where(F.col("cum") >= k).groupBy("point").agg(F.min("d").alias("h"))
    j = pairs.join(radius, "point")
    u = F.when(F.col("h") > 0, F.col("d") / F.col("h")).otherwise(F.lit(0.0))
    t = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(0.0))
    j = j.withColumn("__t", t).withColumn("__in", F.sum(F.col("__t") * F.col("w")).over(Window.partitionBy("point")))
    t = F.when(F.col("__in") > 0, F.col("__t")).otherwise((F.col("d") <= F.col("h")).cast("double"))
    s = (j.withColumn("t", t).groupBy("point", "g").agg(
        F.sum(F.col("t") * F.col("w")).alias("W"), F.sum(F.col("t") * F.col("wx")).alias("WX"),
        F.sum(F.col("t") * F.col("wy")).alias("WY"), F.sum(F.col("t") * F.col("wxx")).alias("WXX"),
        F.sum(F.col("t") * F.col("wxy")).alias("WXY")))
    den = F.col("W") * F.col("WXX") - F.col("WX") * F.col("WX")
    slope = F.when(den > 1e-12 * F.col("W") * F.col("WXX"), (F.col("W") * F.col("WXY") - F.col("WX") * F.col("WY")) / den).otherwise(F.lit(0.0))
    icpt = F.when(F.col("W") > 0, (F.col("WY") - slope * F.col("WX")) / F.col("W"))
    fits = {r["point"]: r["trend"] for r in s.select("point", (icpt + slope * F.col("g")).alias("trend")).collect()}
    known = [i for i in range(len(grid)) if fits.get(i) is not None]

    def value(i: int) -> float:
        left, right = max((p for p in known if p <= i), default=None), min((p for p in known if p >= i), default=None)
        if left is None or right is None or left == right:
            return fits[right if left is None else left]
        return fits[left] + (fits[right] - fits[left]) * (i - left) / (right - left)

    return [value(i) for i in range(len(grid))] if known else [None] * len(grid)


def performance_report(df: DataFrame, label: str, key_cols: Sequence[str], prediction: str = "prediction",
                       path: str | None = None) -> dict[str, DataFrame]:
    """All chart tables of the model report; written as parquet under
    ``path/<chart>`` when a path is given (the reference writes a two-page PDF)."""
    if path:  # every chart reads it, so it is kept until all are written
        df = df.select(*dict.fromkeys([*key_cols, label, prediction])).persist(StorageLevel.MEMORY_AND_DISK)
    detrended = residual_vs_predicted(df, label, key_cols, prediction)
    charts = {
        "actual_vs_predicted": actual_vs_predicted(df, label, prediction),
        "target_range": df.agg(F.min(label).cast("double").alias("min"), F.max(label).cast("double").alias("max")),
        "residual_hist_20": residual_hist(df, label, prediction, 20),
        "residual_density": residual_density(df, label, prediction),
        "residual_vs_predicted": detrended,
        "residual_trend": lowess_trend(detrended, "prediction", "detrended"),
        "error_vs_predicted": error_vs_predicted(df, label, prediction),
    }
    if path:
        try:
            for name, t in charts.items():
                t.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        finally:
            df.unpersist()
    return charts
