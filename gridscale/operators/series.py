"""Per-cell time series: anomalies, lags, sums, gap filling and seasonal-trend decomposition.

All window operators share one partitioning (the cell) so that Spark sorts once for a whole feature set.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["i", "j"]


def in_time():
    """The window of a cell's months, in order."""
    return Window.partitionBy(*CELL).orderBy("t")


def anomaly(value: str) -> Column:
    """Value less the mean of its calendar month over the cell's series."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(*CELL, F.col("t") % 12))


def lagged(value: str, months: int) -> Column:
    return F.lag(value, months).over(in_time())


def rolling_sum(value: str, months: int) -> Column:
    """Sum over the last ``months`` months and this one; null counts as 0, the start is shorter."""
    return F.coalesce(F.sum(value).over(in_time().rowsBetween(1 - months, 0)), F.lit(0.0))


def _three_taps(df: DataFrame, value: str, key: list[str], axis: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(axis)
    edge = Window.partitionBy(*key)
    c = F.col(value)
    before = F.when(F.col(axis) == F.min(axis).over(edge), c).otherwise(F.lag(value).over(w))
    after = F.when(F.col(axis) == F.max(axis).over(edge), c).otherwise(F.lead(value).over(w))
    return df.withColumn(value, before + c + after)


def spatial_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """3 x 3 mean of a complete grid, edges repeated; null wherever a tap is null. Two passes of three taps."""
    x = df.withColumn(out, F.col(value))
    x = _three_taps(_three_taps(x, out, ["t", "i"], "j"), out, ["t", "j"], "i")
    return x.withColumn(out, F.col(out) / 9)


def linear_fill(df: DataFrame, value: str, out: str) -> DataFrame:
    """Straight lines through gaps; the two nearest valid points carry on at both ends, one point is held."""
    back, ahead = in_time().rowsBetween(Window.unboundedPreceding, 0), in_time().rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(*CELL)
    at = F.when(F.col(value).isNotNull(), F.struct("t", F.col(value).alias("v")))
    x = df.withColumn("_at", at)
    x = x.withColumns({"_a": F.last("_at", True).over(back), "_b": F.first("_at", True).over(ahead), "_n": F.row_number().over(in_time()), "_valid": F.sum(F.col(value).isNotNull().cast("int")).over(back)})
    x = x.withColumn("_count", F.max("_valid").over(all_rows))
    pick = lambda k: F.max(F.when(F.col("_at").isNotNull() & (F.col("_valid") == k), F.col("_at"))).over(all_rows)
    x = x.withColumns({"_f1": pick(F.lit(1)), "_f2": pick(F.lit(2)), "_l1": pick(F.col("_count")), "_l2": pick(F.col("_count") - 1)})

    def line(p: str, q: str) -> Column:
        return F.col(f"{p}.v") + (F.col("t") - F.col(f"{p}.t")) * (F.col(f"{q}.v") - F.col(f"{p}.v")) / (F.col(f"{q}.t") - F.col(f"{p}.t"))

    filled = (
        F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_count") == 1, F.coalesce("_a.v", "_b.v"))
        .when(F.col("_a").isNull(), line("_f1", "_f2")).when(F.col("_b").isNull(), line("_l2", "_l1")).otherwise(line("_a", "_b"))
    )
    return x.withColumn(out, filled).select(*df.columns, out)


def gap_runs(df: DataFrame, value: str) -> DataFrame:
    """First and last month of every run of missing months."""
    gaps = df.where(F.col(value).isNull()).withColumn("_g", F.col("t") - F.row_number().over(in_time()))
    return gaps.groupBy(*CELL, "_g").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def fill_short(df: DataFrame, value: str, out: str, longest: int = 3) -> DataFrame:
    """Linear fill of gaps of at most ``longest`` months that touch neither end."""
    x = linear_fill(df, value, "_line")
    runs = Window.partitionBy(*CELL, "_run")
    ends = Window.partitionBy(*CELL)
    x = x.withColumn("_run", F.count(value).over(in_time().rowsBetween(Window.unboundedPreceding, 0)))
    missing = F.sum(F.col(value).isNull().cast("int")).over(runs)
    inner = (F.col("_run") > 0) & (F.col("_run") < F.max("_run").over(ends))
    return x.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(inner & (missing <= longest), F.col("_line"))).select(*df.columns, out)


@lru_cache(maxsize=64)
def _kernel(n: int, span: int, start: int, stop: int) -> np.ndarray:
    """Tricube weights of the places 0..n-1 seen from start..stop-1; the same for every cell of a length."""
    d = np.abs(np.arange(start, stop)[:, None] - np.arange(n)[None, :])
    reach = np.sort(d, axis=1)[:, min(span, n) - 1] * max(span / min(span, n), 1)
    return np.clip(1 - (d / np.maximum(reach, 1e-9)[:, None] / 1.000001) ** 3, 0, None) ** 3


def _loess(y: np.ndarray, weight: np.ndarray, span: int, start: int, stop: int) -> np.ndarray:
    """Local linear fits with tricube weights of ``y`` over 0..n-1 at the places start..stop-1."""
    x, at = np.arange(len(y)), np.arange(start, stop)
    w = _kernel(len(y), span, start, stop) * weight
    s = np.maximum(w.sum(axis=1), 1e-300)
    mean_x, mean_y = (w @ x) / s, (w @ y) / s
    xx = (w @ (x * x)) / s - mean_x**2
    xy = (w @ (x * y)) / s - mean_x * mean_y
    return mean_y + np.where(xx > 1e-9, xy / np.maximum(xx, 1e-9), 0) * (at - mean_x)


def decompose(y: np.ndarray, period: int = 12, seasonal: int = 13, robust: int = 5, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and rest of a complete series, by seasonal-trend smoothing; the three add up to ``y``."""
    n = len(y)
    trend, season, weight = np.zeros(n), np.zeros(n), np.ones(n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    span += 1 - span % 2
    low_span = period + 1 - period % 2
    for outer in range(robust + 1):
        for _ in range(inner):
            free = y - trend
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part, w = free[k::period], weight[k::period]
                if len(part):
                    cycle[k::period][: len(part) + 2] = _loess(part, w, seasonal, -1, len(part) + 1)
            ones = np.ones(period) / period
            low = np.convolve(np.convolve(np.convolve(cycle, ones, "valid"), ones, "valid"), np.ones(3) / 3, "valid")
            low = _loess(low, np.ones(len(low)), low_span, 0, len(low))
            season = cycle[period : period + n] - low[:n]
            trend = _loess(y - season, weight, span, 0, n)
        rest = y - trend - season
        scale = 6 * np.median(np.abs(rest))
        if outer < robust and scale > 1e-12:
            weight = np.clip(1 - (np.abs(rest) / scale) ** 2, 0, None) ** 2
        else:
            break
    return trend, season, y - trend - season


def _line_through(y: np.ndarray) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(y))
    out = np.interp(np.arange(len(y)), known, y[known])
    if len(known) > 1:
        a, b, c, d = known[0], known[1], known[-2], known[-1]
        head, tail = np.arange(a), np.arange(d + 1, len(y))
        out[head] = y[a] + (head - a) * (y[b] - y[a]) / (b - a)
        out[tail] = y[d] + (tail - d) * (y[d] - y[c]) / (d - c)
    return out


def _rebuilt(y: np.ndarray, reconstruct: str) -> np.ndarray:
    trend, season, rest = decompose(_line_through(y))
    if reconstruct == "stl":
        return trend + season
    phase = np.arange(len(y)) % 12
    extra = rest if reconstruct == "climatology" else np.full(len(y), rest.mean())
    part = (season + extra)[-60:] if len(y) > 120 else season + extra
    of = phase[-len(part) :]
    return trend + np.array([part[of == p].mean() for p in phase])


def fill_one(y: np.ndarray, seed: int, reconstruct: str = "stl", least: int = 24, least_held: int = 36) -> tuple[np.ndarray, dict]:
    """A filled series and what was done: observed values stay; below ``least`` valid months nothing is filled."""
    valid = np.flatnonzero(~np.isnan(y))
    told = {"n_valid": len(valid), "n_missing": len(y) - len(valid), "method": "stl", "values_filled": 0, "test_r2": np.nan, "test_rmse": np.nan, "test_mae": np.nan, "validation_points": 0}
    if len(valid) < least:
        return y, told | {"method": "insufficient_data"}
    if len(valid) >= least_held:
        held = np.sort(np.random.default_rng(seed).permutation(valid)[: max(int(0.2 * len(valid)), 6)])
        hidden = y.copy()
        hidden[held] = np.nan
        guess, truth = _rebuilt(hidden, reconstruct)[held], y[held]
        error = truth - guess
        told |= {"test_r2": 1 - (error**2).sum() / max(((truth - truth.mean()) ** 2).sum(), 1e-300), "test_rmse": np.sqrt((error**2).mean()), "test_mae": np.abs(error).mean(), "validation_points": len(held)}
    if len(valid) == len(y):
        return y, told | {"method": "no_gaps"}
    gaps = np.isnan(y)
    filled = np.where(gaps, _rebuilt(y, reconstruct), y)
    return filled, told | {"values_filled": int(gaps.sum())}


INFO = "n_valid long, n_missing long, method string, values_filled long, test_r2 double, test_rmse double, test_mae double, validation_points long"


def stl_fill(df: DataFrame, value: str = "value", reconstruct: str = "stl") -> DataFrame:
    """Every row with ``filled`` and its cell's fill record; one group is one cell's series, some hundred months."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        filled, told = fill_one(g[value].to_numpy(dtype=float), seed=42 + 1000 * int(key[0]) + int(key[1]), reconstruct=reconstruct)
        return g[["t", "i", "j"]].assign(value=g[value], filled=filled, **told)

    return df.groupBy(*CELL).applyInPandas(run, f"t int, i int, j int, value double, filled double, {INFO}")
