"""Statistical column expressions.

All of them are plain Catalyst expressions, so they run inside whole-stage
codegen, work per group (``groupBy(...).agg``) and need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_sig(x, digits: int = 6) -> Column:
    """Round to ``digits`` significant digits.

    Scales by an exact power of ten and rounds to an integer, so that two engines
    that computed the same double also print the same rounded double (rounding
    at a decimal position directly goes through a decimal text form in Spark).
    """
    x = _c(x)
    e = F.floor(F.log10(F.abs(x)))
    k = F.lit(digits - 1) - e
    up = F.round(x * F.pow(F.lit(10.0), k), 0) / F.pow(F.lit(10.0), k)
    down = F.round(x / F.pow(F.lit(10.0), -k), 0) * F.pow(F.lit(10.0), -k)
    finite = ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when((x == 0) | ~finite, x.cast("double"))
            .when(k >= 0, up).otherwise(down))


def sample_skewness(n, g1, var_pop) -> Column:
    """Bias-corrected skewness G1 from Spark's population g1.

    G1 = g1 * sqrt(n (n-1)) / (n-2); null below 3 values; 0 for a constant column.
    """
    n, g1, var_pop = _c(n).cast("double"), _c(g1), _c(var_pop)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(var_pop == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurtosis(n, g2, var_pop) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population excess g2.

    G2 = (n-1) / ((n-2)(n-3)) * ((n+1) g2 + 6); null below 4 values; 0 when constant.
    """
    n, g2, var_pop = _c(n).cast("double"), _c(g2), _c(var_pop)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(var_pop == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def pooled_t_statistic(n1, m1, v1, n2, m2, v2) -> Column:
    """Two-sample t with pooled (equal) variances; v = sample variances.

    Null when the pooled variance is zero or there are fewer than 3 values.
    """
    n1, n2 = _c(n1).cast("double"), _c(n2).cast("double")
    m1, v1, m2, v2 = _c(m1), _c(v1), _c(m2), _c(v2)
    dof = n1 + n2 - 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
    se = F.sqrt(pooled * (1.0 / n1 + 1.0 / n2))
    return F.when((dof > 0) & (se > 0), (m1 - m2) / se)


def t_test_p_value(t, dof, intervals: int = 1000) -> Column:
    """Two-sided Student-t p-value as a column expression.

    With x = sqrt(dof) * tan(theta) the t density in theta is proportional to
    cos(theta)^(dof-1), so p = int_{theta0}^{pi/2} / int_0^{pi/2}, theta0 = atan(|t|/sqrt(dof)).
    Both integrals are taken by Simpson's rule over ``intervals`` steps on
    [.., theta1] with theta1 = min(pi/2, 12/sqrt(dof)) (the integrand is below
    e^-70 of its peak beyond). Agrees with the incomplete-beta form to ~1e-10.
    """
    t, dof = _c(t), _c(dof).cast("double")
    n = intervals
    th0 = F.atan(F.abs(t) / F.sqrt(dof))
    th1 = F.least(F.lit(math.pi / 2), F.lit(12.0) / F.sqrt(dof))

    def simpson(a: Column, b: Column) -> Column:
        h = (b - a) / n

        def step(acc, i):
            w = (F.when((i == 0) | (i == n), F.lit(1.0))
                 .when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)))
            return acc + w * F.pow(F.greatest(F.cos(a + i * h), F.lit(0.0)), dof - 1)

        return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), step) * h / 3

    p = F.when(th0 >= th1, F.lit(0.0)).otherwise(simpson(th0, th1) / simpson(F.lit(0.0), th1))
    return F.when(t.isNull() | dof.isNull() | (dof <= 0), F.lit(None).cast("double")).otherwise(p)
