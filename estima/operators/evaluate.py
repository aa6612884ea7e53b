"""Evaluation: MAE, R^2, the t-test p-value, the composite score and grade.

One aggregate per call, optionally grouped by segment columns, so a model is
evaluated per segment in the same single pass. The p-value is a column
expression (``t_test_p_value``), not a driver step.

Note on the p-value (kept for parity): it tests whether the *means* of actual and
predicted values differ, so a good model has a high p; the reference's labels
read a low p as "significant". On training rows a least-squares fit with an
intercept has equal means, so t = 0 and p = 1 there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estima.functions.stats import pooled_t_statistic, t_test_p_value

# The composite quality score of the reference.
W_R2, W_P, W_MAE = 0.6, 0.2, 0.2
GRADE_EXCELLENT, GRADE_GOOD = 80.0, 60.0
SIGNIFICANCE = 0.05
# The reference's messages.
MSG_SIGNIFICANT = "The model's predictions are statistically significant."
MSG_NOT_SIGNIFICANT = ("The model's predictions are not statistically significant.",
                       "This suggests that the model's performance may be due to chance.",
                       "Consider collecting more data or refining the model.")
MSG_CAUTION = ("Note: While the overall metrics look good, the lack of statistical significance "
               "suggests caution in interpreting the results.")
MSG_RECOMMEND = "Recommendation: Consider using expert mode to improve the model and address statistical significance."


def metrics(df: DataFrame, label: str, prediction: str = "prediction",
            segments: Sequence[str] = ()) -> DataFrame:
    """``(segments..., n, mae, r2, t_stat, dof, p_value)`` over complete rows.

    r2 = 1 - SSE / (n var_pop(y)), not clipped, null for a constant target;
    t: pooled two-sample t of actual vs predicted, dof = 2n - 2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    agg = rows.groupBy(*segments).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("__sse"), F.var_pop(y).alias("__vy"),
        F.avg(y).alias("__my"), F.avg(p).alias("__mp"),
        F.var_samp(y).alias("__sy"), F.var_samp(p).alias("__sp"))
    n = F.col("n")
    r2 = F.when(F.col("__vy") > 0, 1 - F.col("__sse") / (n * F.col("__vy")))
    t = pooled_t_statistic(n, F.col("__my"), F.col("__sy"), n, F.col("__mp"), F.col("__sp"))
    dof = (2 * n - 2).cast("double")
    return agg.select(*segments, "n", "mae", r2.alias("r2"), t.alias("t_stat"), dof.alias("dof"),
                      t_test_p_value(t, dof).alias("p_value"))


def mae(df: DataFrame, label: str, prediction: str = "prediction", segments: Sequence[str] = ()) -> DataFrame:
    return metrics(df, label, prediction, segments).select(*segments, "mae")


def r2(df: DataFrame, label: str, prediction: str = "prediction", segments: Sequence[str] = ()) -> DataFrame:
    return metrics(df, label, prediction, segments).select(*segments, "r2")


def t_test(df: DataFrame, label: str, prediction: str = "prediction", segments: Sequence[str] = ()) -> DataFrame:
    return metrics(df, label, prediction, segments).select(*segments, "t_stat", "dof", "p_value")


def quality_score_expr(r2: Column, p: Column, mae: Column) -> Column:
    """100 (0.6 min(r2,1) + 0.2 (1 - min(p,1)) + 0.2 / (1 + mae))."""
    return 100 * (W_R2 * F.least(r2, F.lit(1.0)) + W_P * (1 - F.least(p, F.lit(1.0))) + W_MAE / (1 + mae))


def quality_grade_expr(score: Column) -> Column:
    return (F.when(score > GRADE_EXCELLENT, F.lit("Excellent"))
            .when(score > GRADE_GOOD, F.lit("Good")).otherwise(F.lit("Needs Improvement")))


def quality_score(m: DataFrame) -> DataFrame:
    """Append ``score`` to a metrics table."""
    return m.withColumn("score", quality_score_expr(F.col("r2"), F.col("p_value"), F.col("mae")))


def quality_grade(m: DataFrame) -> DataFrame:
    """Append ``score`` and ``grade`` (> 80 Excellent, > 60 Good, else Needs Improvement)."""
    s = quality_score(m)
    return s.withColumn("grade", quality_grade_expr(F.col("score")))


def significance_notes(m: DataFrame) -> DataFrame:
    """Append ``significant`` and the report's notes as an array of text."""
    g = m if "grade" in m.columns else quality_grade(m)
    p = F.col("p_value")
    sig = F.coalesce(p < SIGNIFICANCE, F.lit(False))  # no p-value: not significant
    notes = F.array_compact(F.array(
        F.when(sig, F.lit(MSG_SIGNIFICANT)),
        *[F.when(~sig, F.lit(t)) for t in MSG_NOT_SIGNIFICANT],
        F.when((F.col("grade") == "Good") & ~sig, F.lit(MSG_CAUTION)),
        F.when((F.col("grade") == "Needs Improvement") | ~sig, F.lit(MSG_RECOMMEND))))
    return g.withColumn("significant", sig).withColumn("notes", notes)


def metric_report(m: DataFrame, mode: str = "expert", segments: Sequence[str] = ()) -> DataFrame:
    """Rounded figures as reported: expert (r2 2, mae 2, p 4 places) or auto
    (score 1, r2 in percent 1, mae 2, grade)."""
    if mode == "expert":
        return m.select(*segments, F.round("r2", 2).alias("r2"), F.round("mae", 2).alias("mae"),
                        F.round("p_value", 4).alias("p_value"))
    g = m if "grade" in m.columns else quality_grade(m)
    return g.select(*segments, "grade", F.round("score", 1).alias("score"),
                    F.round(F.col("r2") * 100, 1).alias("r2_pct"), F.round("mae", 2).alias("mae"))
