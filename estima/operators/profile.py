"""Column statistics: profile, screening flags, entropy, frequencies, ranges.

Everything here is a handful of aggregates over the data:

* per-column moments of all numeric columns come from one grouped aggregate over the
  unpivoted ``(column, value)`` form (partial aggregation map-side, one tiny shuffle);
* distinct counts use an unpivot to ``(column, value-hash)`` pairs and one
  grouped distinct, instead of k ``countDistinct`` (which plans an ``Expand`` by k);
* exact quantiles (median, quartiles): groups of at most 50,000 values in one
  grouped ``percentile``; larger groups by histogram refinement (at most 7 grouped
  passes for any data, state kept in DataFrames); never a whole large group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estima.operators.columns import join_on_keys, split_roles

_MAX_BROADCAST_STATES = 100_000


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit_name(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unpivot(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (),
            value_type: str = "double", drop_missing: bool = True) -> DataFrame:
    """``(groups..., column, value)`` long form, one row per non-missing cell.

    NaN counts as missing for floating columns, as in pandas."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [], T.StructType([*[df.schema[g] for g in groups],
                              T.StructField("column", T.StringType()),
                              T.StructField("value", T.StringType() if value_type == "string" else T.DoubleType())]))
    parts = ", ".join(f"{_lit_name(c)}, CAST({_q(c)} AS {value_type})" for c in columns)
    long = df.selectExpr(*[_q(g) for g in groups],
                         f"stack({len(columns)}, {parts}) AS (column, value)")
    if drop_missing:
        cond = F.col("value").isNotNull()
        if value_type == "double":
            cond = cond & ~F.isnan("value")
        long = long.where(cond)
    return long


def _nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in fl and c in columns
                       else F.col(c) for c in df.columns])


# --------------------------------------------------------------------------- quantiles

def _monotone_code(v):
    """A whole number that rises with the value: sign and binary exponent, with own codes for the
    infinities and 0. Values of one code (other than 0 and the infinities) are within a factor of
    two of each other and have one sign."""
    exponent = F.floor(F.log2(F.abs(v))).cast("int") + 1200
    return (F.when(v == 0, 0).when(v == float("inf"), 3000).when(v == float("-inf"), -3000)
            .when(v > 0, exponent).otherwise(-exponent))


#: Bits that tell all values of one code apart: 52 of a double, and two as codes are cut by a rounded logarithm.
_FINEST = 54


def _cell(v, bits: int):
    """The number, rising with the value, of its cell where the values of one code are cut into 2^bits equal ones."""
    if not bits:
        return F.lit(0).cast("long")
    exponent = F.floor(F.log2(F.abs(v))).cast("int")
    half = F.floor(exponent / 2)
    # by powers of two in two steps, which neither round nor overflow
    share = F.abs(v) * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent) - 1
    number = F.floor(share * float(2**bits)).cast("long")
    return F.when((v == 0) | (F.abs(v) == float("inf")), F.lit(0).cast("long")).when(v > 0, number).otherwise(-number)


def _bin_of_rank(hist: DataFrame, targets: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """For each target (keys, rank, below) the bin of ``hist`` (keys, code, n, mn, mx) that holds the
    rank; a bracket has at most ``buckets`` (or the number of codes) bins."""
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(code).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("__cum", F.sum("n").over(w))
    got = join_on_keys(targets, cum, keys)
    local = F.col("rank") - F.col("below")
    got = got.where((local >= F.col("__cum") - F.col("n")) & (local < F.col("__cum")))
    return got.withColumn("below", F.col("below") + F.col("__cum") - F.col("n"))


def order_statistics(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,),
                     groups: Sequence[str] = (), buckets: int = 1024, collect_limit: int = 50_000,
                     base: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default,
    ``quantile_cont``) per ``(groups, column, prob)``.

    Pass 1 (or the caller's ``base`` with ``(groups, column, n, lo, hi)``, one row
    per group and column): count, min and max per group.

    * Groups with at most ``collect_limit`` values (any number of them) are done
      in one distributed aggregate: Spark's exact ``percentile``, which buffers the
      values of one group, here bounded by ``collect_limit``.
    * Larger groups are refined. The first pass bins the values by sign and binary
      exponent (the infinities have bins of their own); each further pass splits the
      bracket that holds a wanted rank into ``buckets`` equal bins (of a power of two), whose
      count, min and max come from one grouped aggregate over the values inside the bracket. A
      value finds its bracket by the number of its cell, one lookup however many brackets are open. A
      bracket whose min equals its max is the value. Inside one binade doubles are
      evenly spaced, 2^52 of them, so 7 passes end it for any data. Brackets and
      their choice stay in DataFrames; the driver reads one number a pass.

    No group is ever gathered into one task beyond ``collect_limit`` values.
    """
    keys = [*groups, "column"]
    long = unpivot(df, columns, groups)
    if base is None:
        base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"),
                                       F.max("value").alias("hi"))
    from estima.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    base = base.select(*[F.col(_q(k)) for k in keys], "n", "lo", "hi").checkpoint(eager=True)
    quoted = [F.col(_q(k)) for k in keys]

    # small groups: one exact grouped percentile, fully distributed
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    small_keys = base.where(F.col("n") <= collect_limit).select(*quoted)
    if base.count() <= _MAX_BROADCAST_STATES:  # so that the values of large groups don't travel
        small_keys = F.broadcast(small_keys)
    small = (join_on_keys(long, small_keys, keys).groupBy(*quoted).agg(F.percentile(F.col("value"), wanted).alias("__q"))
             .select(*quoted, F.posexplode("__q").alias("__i", "value"))
             .select(*quoted, F.element_at(wanted, F.col("__i") + 1).alias("prob"), "value"))
    large = base.where(F.col("n") > collect_limit)
    held = large.count()
    if not held:
        return small

    # the two ranks around each quantile
    rank = (F.col("n") - 1) * F.col("prob")
    asked = large.withColumn("prob", F.explode(wanted)).withColumn("__h", rank)
    asked = asked.select(*quoted, "prob", "__h", F.floor("__h").cast("long").alias("__r0"),
                         F.least(F.floor("__h").cast("long") + 1, F.col("n") - 1).alias("__r1"))
    ranks = asked.select(*quoted, F.explode(F.array("__r0", "__r1")).alias("rank")).distinct()
    found = _refine(long, large, ranks, keys, buckets, held)
    at0 = found.select(*quoted, F.col("rank").alias("__r0"), F.col("value").alias("__v0"))
    at1 = found.select(*quoted, F.col("rank").alias("__r1"), F.col("value").alias("__v1"))
    got = join_on_keys(join_on_keys(asked, at0, [*keys, "__r0"]), at1, [*keys, "__r1"])
    # equal neighbours need no interpolation (inf - inf is no number)
    value = F.when(F.col("__v0") == F.col("__v1"), F.col("__v0")).otherwise(
        F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__h") - F.col("__r0")))
    return small.unionByName(got.select(*quoted, "prob", value.alias("value")))


def _refine(long: DataFrame, large: DataFrame, ranks: DataFrame, keys: list[str], buckets: int, groups: int) -> DataFrame:
    """``(keys, rank, value)`` of the wanted ranks of the ``groups`` large groups (see ``order_statistics``)."""
    quoted = [F.col(_q(k)) for k in keys]
    names = large.select(*quoted)
    if groups <= _MAX_BROADCAST_STATES:  # else a shuffle would bring all values of a group to one task
        names = F.broadcast(names)
    v, state = F.col("value"), [*keys, "__code", "__cell"]
    coded = join_on_keys(long, names, keys).withColumn("__code", _monotone_code(v))
    code = coded.groupBy(*quoted, "__code").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx"))
    targets = _bin_of_rank(code, ranks.withColumn("below", F.lit(0).cast("long")), keys, "__code")
    targets = targets.select(*quoted, "__code", F.lit(0).cast("long").alias("__cell"), "rank", "below",
                             F.col("mn").alias("__lo"), F.col("mx").alias("__hi")).checkpoint(eager=True)
    done, bits, step = [], 0, max(1, (buckets - 1).bit_length())
    while True:
        done.append(targets.where(F.col("__lo") == F.col("__hi")).select(*quoted, "rank", F.col("__lo").alias("value")))
        targets = targets.where(F.col("__lo") < F.col("__hi"))
        brackets = targets.select(*[F.col(_q(k)) for k in state]).distinct()
        held = brackets.count()
        if not held:
            break
        if held <= _MAX_BROADCAST_STATES:  # one row per open bracket: size known
            brackets = F.broadcast(brackets)
        # a value's cell is a function of the value alone, so it meets its own bracket, not all of its column's
        more = min(bits + step, _FINEST)
        hist = (join_on_keys(coded.withColumn("__cell", _cell(v, bits)), brackets, state).groupBy(*[F.col(_q(k)) for k in state], _cell(v, more).alias("__b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("mn"), F.max("value").alias("mx")))
        targets = _bin_of_rank(hist, targets, state, "__b").select(
            *quoted, "__code", F.col("__b").alias("__cell"), "rank", "below", F.col("mn").alias("__lo"), F.col("mx").alias("__hi")).checkpoint(eager=True)
        bits = more
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# --------------------------------------------------------------------------- profile

def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                    groups: Sequence[str] = (), decimals: int | None = 4) -> DataFrame:
    """min, max, mean, median, std (n-1), skewness (G1), excess kurtosis (G2) per
    numeric column (and group); nulls/NaN skipped; mean..kurtosis rounded to
    ``decimals`` places as in the reference's report (``None``: unrounded).

    One aggregate for the moments, one exact-quantile run for the medians, joined
    on ``(groups, column)`` (one row per column and group on both sides)."""
    if columns is None:
        columns = [c for c in split_roles(df)[0] if c not in groups]
    keys = [*groups, "column"]
    long = unpivot(df, columns, groups)
    from estima.functions.stats import sample_kurtosis, sample_skewness
    # one pass for the moments; its count/min/max also start the exact median search
    mom = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.var_pop("value").alias("__vp"), F.skewness("value").alias("__g1"),
        F.kurtosis("value").alias("__g2"))
    mom = mom.select(*keys, "n", "min", "max", "mean", "std",
                     sample_skewness("n", "__g1", "__vp").alias("skewness"),
                     sample_kurtosis("n", "__g2", "__vp").alias("kurtosis"))
    # one row per (group, column); read twice, so written once to the checkpoint folder
    from estima.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    mom = mom.checkpoint(eager=True)
    base = mom.select(*keys, "n", F.col("min").alias("lo"), F.col("max").alias("hi"))
    med = order_statistics(df, columns, (0.5,), groups, base=base) \
        .select(*keys, F.col("value").alias("median"))
    out = join_on_keys(mom, med, keys, "left")

    if not groups:
        # every requested column appears, a column without values with n = 0
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        out = names.join(out, "column", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))

    def rnd(c):
        return F.round(F.col(c), decimals).alias(c) if decimals is not None else F.col(c)

    return out.select(*keys, "n", "min", "max", rnd("mean"), rnd("median"), rnd("std"),
                      rnd("skewness"), rnd("kurtosis"))


def skew_kurt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only skewness and kurtosis (unrounded) for the given columns."""
    long = unpivot(df, columns)
    from estima.functions.stats import sample_kurtosis, sample_skewness
    agg = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("vp"),
                                     F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    return agg.select("column", sample_skewness("n", "g1", "vp").alias("skewness"),
                      sample_kurtosis("n", "g2", "vp").alias("kurtosis"))


def grouped_profile(df: DataFrame, groups: Sequence[str], columns: Sequence[str] | None = None,
                    decimals: int | None = 4) -> DataFrame:
    """``profile_numeric`` per group of categorical columns."""
    return profile_numeric(df, columns, groups, decimals)


# --------------------------------------------------------------------------- screening

def no_variation(df: DataFrame, columns: Sequence[str] | None = None,
                 groups: Sequence[str] = ()) -> DataFrame:
    """Columns with exactly one distinct non-missing value (per group).

    ``min = max`` over non-null values is that test in one pass without a
    distinct count; an all-missing column has min null and is not flagged.
    Result ``(groups..., column, position)`` of flagged columns only."""
    columns = [c for c in (columns or df.columns) if c not in groups]
    types = {f.name: f.dataType for f in df.schema.fields}
    src = _nan_to_null(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c)
        if isinstance(types[c], (T.MapType, T.ArrayType, T.StructType, T.BinaryType)):
            continue
        aggs.append((F.min(v) == F.max(v)).alias(f"f{i}"))
    wide = src.groupBy(*groups).agg(*aggs) if aggs else None
    if wide is None:
        return df.sparkSession.createDataFrame([], "column string, position int")
    flags = [f"f{i}" for i, c in enumerate(columns) if f"f{i}" in wide.columns]
    stack = ", ".join(f"{_lit_name(columns[int(f[1:])])}, {df.columns.index(columns[int(f[1:])]) + 1}, {f}"
                      for f in flags)
    long = wide.selectExpr(*[_q(g) for g in groups],
                           f"stack({len(flags)}, {stack}) AS (column, position, flagged)")
    return long.where(F.col("flagged")).select(*groups, "column", F.col("position").cast("int"))


def coeff_variation(df: DataFrame, columns: Sequence[str] | None = None,
                    threshold: float = 1.0) -> DataFrame:
    """std (n-1) / mean per numeric column, ``flagged`` when > threshold.

    Undefined values (fewer than 2 values, 0/0) are dropped, as the reference
    drops NaN; zero mean with spread is +/-infinity; a negative mean gives a
    negative CV that is never flagged."""
    if columns is None:
        columns = split_roles(df)[0]
    long = unpivot(df, columns)
    agg = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    inf = F.lit(float("inf"))
    cv = (F.when(F.col("std").isNull(), F.lit(None).cast("double"))
          .when(F.col("mean") == 0, F.when(F.col("std") == 0, F.lit(None).cast("double")).otherwise(inf))
          .otherwise(F.col("std") / F.col("mean")))
    return (agg.select("column", "mean", "std", cv.alias("cv"))
            .where(F.col("cv").isNotNull())
            .withColumn("flagged", F.col("cv") > F.lit(threshold)))


def unique_ratio(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.9,
                 exact: bool = True, rsd: float = 0.01, band: float = 0.05) -> DataFrame:
    """distinct non-missing values / all rows per categorical column; ``flagged``
    when > threshold.

    ``exact``: one grouped distinct over ``(column, md5(value))`` pairs (the hash
    keeps the shuffle narrow for long text). Otherwise an HLL estimate for every
    column in one pass, and the exact count only for columns whose estimate lies
    within ``band`` of the threshold."""
    if columns is None:
        columns = split_roles(df)[1]
    n_rows = F.count(F.lit(1))
    if not exact:
        est = df.agg(n_rows.alias("__n"), *[F.approx_count_distinct(F.col(c), rsd).alias(f"a{i}")
                                            for i, c in enumerate(columns)]).first()
        n = est["__n"]
        near = [c for i, c in enumerate(columns)
                if n and abs(est[f"a{i}"] / n - threshold) <= band]
        approx_rows = [(c, n, est[f"a{i}"], False) for i, c in enumerate(columns) if c not in near]
        exact_df = unique_ratio(df, near, threshold, True) if near else None
        spark = df.sparkSession
        a = spark.createDataFrame(approx_rows, "column string, n_rows bigint, n_distinct bigint, exact boolean")
        a = a.select("column", "n_rows", "n_distinct",
                     F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).alias("ratio"), "exact")
        a = a.withColumn("flagged", F.col("ratio") > threshold)
        if exact_df is not None:
            a = a.unionByName(exact_df.withColumn("exact", F.lit(True)).select(a.columns))
        return a
    long = unpivot(df, columns, value_type="string")
    n_distinct = (long.select("column", F.md5("value").alias("h")).distinct()
                  .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
    total = df.agg(n_rows).scalar()
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = (names.join(n_distinct, "column", "left")
           .select("column", total.alias("n_rows"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))
    return out.select("column", "n_rows", "n_distinct",
                      F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).alias("ratio")) \
              .withColumn("flagged", F.col("ratio") > F.lit(threshold))


def high_variation(df: DataFrame, cv_threshold: float = 1.0, ratio_threshold: float = 0.9,
                   exact: bool = True) -> DataFrame:
    """Union of CV-flagged numeric and ratio-flagged categorical columns:
    ``(column, rule, value)``, numeric rules first."""
    num, cat = split_roles(df)
    cv = coeff_variation(df, num, cv_threshold).where("flagged") \
        .select("column", F.lit("coeff_variation").alias("rule"), F.col("cv").alias("value"))
    ur = unique_ratio(df, cat, ratio_threshold, exact).where("flagged") \
        .select("column", F.lit("unique_ratio").alias("rule"), F.col("ratio").alias("value"))
    return cv.unionByName(ur)


def filter_threshold(stats: DataFrame, stat_col: str, op: str, threshold: float) -> DataFrame:
    """Predicate filter over a per-column statistics table (``> >= < <= = !=``)."""
    c = F.col(stat_col)
    ops = {">": c > threshold, ">=": c >= threshold, "<": c < threshold,
           "<=": c <= threshold, "=": c == threshold, "!=": c != threshold}
    return stats.where(ops[op])


# --------------------------------------------------------------------------- frequencies

def entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shannon entropy in bits of each column's value frequencies (nulls excluded):
    H = log2 N - (1/N) sum n log2 n, from one grouped count per (column, value),
    partially aggregated map-side (a hot value costs one row per partition)."""
    if columns is None:
        columns = split_roles(df)[1]
    long = unpivot(df, columns, value_type="string")
    # only counts per distinct value matter: group by the value's md5, a narrow
    # fixed-size key even for long text
    counts = long.groupBy("column", F.md5("value").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    agg = counts.groupBy("column").agg(F.sum("n").alias("N"),
                                       F.sum(F.col("n") * F.log2(F.col("n"))).alias("S"))
    return agg.select("column", (F.log2(F.col("N")) - F.col("S") / F.col("N")).alias("entropy"))


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(value, count, frequency)``: relative frequency among non-missing values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.col(column))).scalar()
    return counts.select("value", "count", (F.col("count") / total).alias("frequency"))


def target_range(df: DataFrame, column: str) -> DataFrame:
    """min and max of a column (the ends of the identity line of a scatter)."""
    return df.agg(F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"))
