"""Queries over per-cell time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as op
from ..sources.bind import observed, second, signal, sql
from .book import Book
from .grid_queries import near, r6

book = Book()
CELL = "PARTITION BY i, j ORDER BY t"


@book.add("win01_anomaly", sql("SELECT t, i, j, round(value - avg(value) OVER (PARTITION BY i, j, t % 12) + 1e-7, 6) AS value_anom FROM signal"))
def anomaly(spark, sf):
    return signal(spark, sf).select("t", "i", "j", near(op.anomaly("value"), 6).alias("value_anom"))


@book.add("win02_lags", sql(f"SELECT t, i, j, round(lag(pr, 1) OVER ({CELL}) + 1e-7, 6) AS pr_lag1, round(lag(pr, 3) OVER ({CELL}) + 1e-7, 6) AS pr_lag3, round(lag(pr + 1e-7, 6) OVER ({CELL}) + 1e-7, 6) AS pr_lag6 FROM signal"))
def lags(spark, sf):
    return signal(spark, sf).select("t", "i", "j", *[near(op.lagged("pr", k), 6).alias(f"pr_lag{k}") for k in (1, 3, 6)])


@book.add("win03_accumulation", sql("SELECT t, i, j, " + ", ".join(f"round(coalesce(sum(pr) OVER ({CELL} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) + 1e-7, 6) AS pr_accum{k}m" for k in (3, 6, 12)) + " FROM signal"))
def accumulation(spark, sf):
    return signal(spark, sf).select("t", "i", "j", *[near(op.rolling_sum("pr", k), 6).alias(f"pr_accum{k}m") for k in (3, 6, 12)])


_TAPS = "x AS (SELECT t, i, j, CASE WHEN j = min(j) OVER (PARTITION BY t, i) THEN {v} ELSE lag({v}) OVER (PARTITION BY t, i ORDER BY j) END + {v} + CASE WHEN j = max(j) OVER (PARTITION BY t, i) THEN {v} ELSE lead({v}) OVER (PARTITION BY t, i ORDER BY j) END AS v FROM {s}), y AS (SELECT t, i, j, CASE WHEN i = min(i) OVER (PARTITION BY t, j) THEN v ELSE lag(v) OVER (PARTITION BY t, j ORDER BY i) END + v + CASE WHEN i = max(i) OVER (PARTITION BY t, j) THEN v ELSE lead(v) OVER (PARTITION BY t, j ORDER BY i) END AS v FROM x)"


@book.add("win04_spatial_mean", sql("SELECT t, i, j, round(v/9 + 1e-7, 6) AS pr_spatial FROM y", _TAPS.format(v="pr", s="signal")))
def spatial_mean(spark, sf):
    return op.spatial_mean(signal(spark, sf).select("t", "i", "j", "pr"), "pr", "pr_spatial").select("t", "i", "j", r6("pr_spatial"))


@book.add("win05_feature_chain", sql("SELECT t, i, j, round(z.a + 1e-7, 6) AS pr_anom, round(v/9 + 1e-7, 6) AS pr_anom_spatial FROM y JOIN z USING (t, i, j)", "z AS (SELECT t, i, j, pr - avg(pr) OVER (PARTITION BY i, j, t % 12) AS a FROM signal)", _TAPS.format(v="a", s="z")))
def feature_chain(spark, sf):
    x = signal(spark, sf).select("t", "i", "j", op.anomaly("pr").alias("pr_anom"))
    return op.spatial_mean(x, "pr_anom", "s").select("t", "i", "j", r6("pr_anom"), r6("s", "pr_anom_spatial"))


_LINE = """k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS UNBOUNDED PRECEDING) AS ta, last_value(value IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS UNBOUNDED PRECEDING) AS va,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb, first_value(value IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM signal),
o AS (SELECT i, j, t, value, row_number() OVER (PARTITION BY i, j ORDER BY t) AS up, row_number() OVER (PARTITION BY i, j ORDER BY t DESC) AS down FROM signal WHERE value IS NOT NULL),
e AS (SELECT i, j, count(*) AS n, max(CASE WHEN up=1 THEN t END) AS t1, max(CASE WHEN up=1 THEN value END) AS v1, max(CASE WHEN up=2 THEN t END) AS t2, max(CASE WHEN up=2 THEN value END) AS v2,
  max(CASE WHEN down=1 THEN t END) AS t3, max(CASE WHEN down=1 THEN value END) AS v3, max(CASE WHEN down=2 THEN t END) AS t4, max(CASE WHEN down=2 THEN value END) AS v4 FROM o GROUP BY i, j),
line AS (SELECT k.t, k.i, k.j, value, CASE WHEN value IS NOT NULL THEN value WHEN n = 1 THEN coalesce(va, vb) WHEN ta IS NULL THEN v1+(k.t-t1)*(v2-v1)/(t2-t1) WHEN tb IS NULL THEN v4+(k.t-t4)*(v3-v4)/(t3-t4) ELSE va+(k.t-ta)*(vb-va)/(tb-ta) END AS filled FROM k JOIN e USING (i, j))"""


@book.add("ts01_linear_fill", sql("SELECT t, i, j, round(filled + 1e-7, 6) AS filled FROM line", _LINE))
def linear_fill(spark, sf):
    return op.linear_fill(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled").select("t", "i", "j", r6("filled"))


@book.add("ts02_short_gaps", sql("SELECT t, i, j, round(CASE WHEN value IS NOT NULL THEN value WHEN r > 0 AND r < max(r) OVER (PARTITION BY i, j) AND sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY i, j, r) <= 3 THEN filled END + 1e-7, 6) AS filled FROM (SELECT *, count(value) OVER (PARTITION BY i, j ORDER BY t) AS r FROM line)", _LINE))
def short_gaps(spark, sf):
    return op.fill_short(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled").select("t", "i", "j", r6("filled"))


@book.add("win06_extension", sql("SELECT t, i, j, round(filled + 1e-7, 6) AS value FROM line", _LINE))
def extension(spark, sf):
    return op.linear_fill(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled").select("t", "i", "j", r6("filled", "value"))


#: Both series (s = 1, 2) on all cells and on the union of their months, filled as in ``_LINE``.
_UNION = """axis AS (SELECT t FROM fine UNION SELECT t FROM second),
grid AS (SELECT t, i, j FROM (SELECT i, j FROM fine UNION SELECT i, j FROM second) CROSS JOIN axis),
ser AS (SELECT 1 AS s, g.t, g.i, g.j, f.value FROM grid g LEFT JOIN fine f USING (t, i, j) UNION ALL SELECT 2, g.t, g.i, g.j, o.other FROM grid g LEFT JOIN second o USING (t, i, j)),
""" + _LINE.replace("signal", "ser").replace("PARTITION BY i, j", "PARTITION BY s, i, j").replace("GROUP BY i, j", "GROUP BY s, i, j").replace("USING (i, j)", "USING (s, i, j)").replace("SELECT i, j", "SELECT s, i, j").replace("k.t, k.i, k.j", "k.s, k.t, k.i, k.j")


@book.add("win06_union_extension", sql("SELECT g.t, g.i, g.j, round(a.filled + 1e-7, 6) AS value, round(b.filled + 1e-7, 6) AS other FROM grid g LEFT JOIN (SELECT * FROM line WHERE s = 1) a USING (t, i, j) LEFT JOIN (SELECT * FROM line WHERE s = 2) b USING (t, i, j)", _UNION))
def union_extension(spark, sf):
    """Both products on the union of their month axes, every month, filled and carried on past their ends."""
    x, y = observed(spark, sf).select("t", "i", "j", "value"), second(spark, sf)
    months = x.select("t").union(y.select("t")).distinct()
    cells = x.select("i", "j").union(y.select("i", "j")).distinct()
    grid = cells.crossJoin(F.broadcast(months))  # the month axis: some hundreds of rows
    both = grid.join(x, ["t", "i", "j"], "left").join(y, ["t", "i", "j"], "left")
    filled = op.linear_fill(op.linear_fill(both, "value", "a"), "other", "b")
    return filled.select("t", "i", "j", r6("a", "value"), r6("b", "other"))


@book.add("win07_gap_runs", sql("SELECT i, j, min(t) AS first, max(t) AS last, count(*) AS length FROM (SELECT i, j, t, t - row_number() OVER (PARTITION BY i, j ORDER BY t) AS g FROM signal WHERE value IS NULL) GROUP BY i, j, g"))
def gap_runs(spark, sf):
    return op.gap_runs(signal(spark, sf), "value").select("i", "j", "first", "last", "length")


@book.add("win10_temporal_blocks", sql("SELECT b AS block, min(t) AS t_min, max(t) AS t_max, count(*) AS n_months FROM (SELECT t, least((dense_rank() OVER (ORDER BY t) - 1) // ((SELECT count(DISTINCT t) FROM fine) // 4), 3) AS b FROM (SELECT DISTINCT t FROM fine)) GROUP BY b"))
def temporal_blocks(spark, sf):
    from ..operators.folds import temporal_blocks as blocks

    return blocks(observed(spark, sf), 4).groupBy("block").agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("n_months"))


@book.add("ts04_stl_fill")
def stl_fill(spark, sf):
    return op.stl_fill(signal(spark, sf).select("t", "i", "j", "value")).select("t", "i", "j", "value", "filled", "method")


@book.add("ts05_stl_validation")
def stl_validation(spark, sf):
    x = op.stl_fill(signal(spark, sf).select("t", "i", "j", "value"))
    return x.groupBy("i", "j").agg(*[F.first(c).alias(c) for c in ("n_valid", "n_missing", "method", "values_filled", "test_r2", "test_rmse", "test_mae", "validation_points")])


@book.add("ts06_climatology_fill")
def climatology_fill(spark, sf):
    return op.stl_fill(signal(spark, sf).select("t", "i", "j", "value"), reconstruct="climatology").select("t", "i", "j", "filled")


@book.add("ts07_mean_residual_fill")
def mean_residual_fill(spark, sf):
    return op.stl_fill(signal(spark, sf).select("t", "i", "j", "value"), reconstruct="mean_residual").select("t", "i", "j", "filled")


@book.add("agg19_fill_run")
def fill_run(spark, sf):
    x = stl_validation(spark, sf)
    return x.groupBy("method").agg(F.count(F.lit(1)).alias("cells"), F.sum("values_filled").alias("values_filled"), F.avg("test_r2").alias("mean_r2"), F.avg("test_rmse").alias("mean_rmse"), F.count_if(F.col("test_r2") >= 0.97).alias("good_r2"), F.count_if(F.col("test_rmse") <= 1.3).alias("good_rmse"))
