"""Metric tables: one aggregation each, never a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """n, r2, rmse, mae, bias, correlation, slope and intercept over rows where both are known.

    The total sum of squares comes from the population variance, so one pass is enough. Where truth or guess doesn't
    vary, what would divide by its variance is null.
    """
    x = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    e = F.col(guess) - F.col(truth)
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(F.lit(1)))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"), F.try_divide(F.covar_pop(truth, guess), F.stddev_pop(truth) * F.stddev_pop(guess)).alias("r"), F.regr_slope(guess, truth).alias("slope"), F.regr_intercept(guess, truth).alias("intercept"),
    )


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, extremes, quartiles and counts; nulls are skipped."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    x = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"), F.count(value).alias("n_valid"), F.count(F.lit(1)).alias("n_total"))
    return x.select(*by, "mean", "std", "min", "max", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), "n_valid", "n_total", (100.0 * F.col("n_valid") / F.col("n_total")).alias("pct_valid"))


def p_value(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by numeric integration of Student's t density."""
    import math

    import numpy as np

    if n < 3 or not abs(r) < 1:
        return 0.0 if n >= 3 else math.nan
    d = n - 2
    t = abs(r) * math.sqrt(d / (1 - r * r))
    u = np.linspace(0, math.atan(t / math.sqrt(d)), 20001)
    y = np.cos(u) ** (d - 1)
    c = math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(math.pi)
    return float(max(0.0, 1 - 2 * c * np.trapezoid(y, u)))
