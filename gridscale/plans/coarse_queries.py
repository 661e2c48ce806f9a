"""Queries over block aggregation and the way back to the fine grid."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import series, weights
from ..operators.coarsen import coarsen, method_of
from ..operators.metrics import regression
from ..sources.bind import FACTOR, LAT0, SIDE, STEP, observed, second, signal, sql, static
from .book import Book
from .grid_queries import near, r6

book = Book()
N = SIDE // FACTOR
RULES = [("aet|tm", "mean"), ("land_cover", "mode"), ("pr|chirps", "sum")]


def _coarse(spark, sf):
    return coarsen(signal(spark, sf), FACTOR, {"value": "mean", "pr": "sum"}, SIDE, SIDE)


def _cells(spark, sf):
    return observed(spark, sf).select("i", "j").distinct()


@book.add("flagship", sql("""SELECT t, ci, cj, round(value + 1e-7, 6) AS value, round(pr + 1e-7, 6) AS pr, round(value - avg(value) OVER (PARTITION BY ci, cj, t % 12) + 1e-7, 6) AS value_anom,
round(lag(value) OVER (PARTITION BY ci, cj ORDER BY t) + 1e-7, 6) AS value_lag1, round(sum(pr) OVER (PARTITION BY ci, cj ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1e-7, 6) AS pr_accum3m, round(other + 1e-7, 6) AS other
FROM coarse LEFT JOIN (SELECT t, i//5 AS ci, j//5 AS cj, avg(other) AS other FROM second GROUP BY 1,2,3) USING (t, ci, cj)"""))
def flagship(spark, sf):
    c = _coarse(spark, sf).withColumnsRenamed({"ci": "i", "cj": "j"})
    c = c.select("t", "i", "j", "value", "pr", series.anomaly("value").alias("value_anom"), series.lagged("value", 1).alias("value_lag1"), series.rolling_sum("pr", 3).alias("pr_accum3m")).withColumnsRenamed({"i": "ci", "j": "cj"})
    o = coarsen(second(spark, sf), FACTOR, {"other": "mean"}, SIDE, SIDE)
    return c.join(o, ["t", "ci", "cj"], "left").select("t", "ci", "cj", *[r6(x) for x in ("value", "pr", "value_anom", "value_lag1", "pr_accum3m", "other")])


@book.add("agg01_block_mean_sum_median", sql("SELECT t, i//3 AS ci, j//3 AS cj, round(avg(value) + 1e-7, 6) AS value, round(coalesce(sum(pr), 0) + 1e-7, 6) AS pr, round(quantile_cont(aet, 0.5) + 1e-7, 6) AS aet FROM signal WHERE i < 18 AND j < 18 GROUP BY 1, 2, 3"))
def blocks(spark, sf):
    return coarsen(signal(spark, sf), 3, {"value": "mean", "pr": "sum", "aet": "median"}, SIDE, SIDE).select("t", "ci", "cj", r6("value"), r6("pr"), r6("aet"))


@book.add("agg01_block_mode", sql("SELECT t, ci, cj, v AS chirps FROM (SELECT *, row_number() OVER (PARTITION BY t, ci, cj ORDER BY n DESC, v) AS r FROM (SELECT t, i//5 AS ci, j//5 AS cj, chirps AS v, count(*) AS n FROM fine GROUP BY ALL)) WHERE r = 1"))
def block_mode(spark, sf):
    return coarsen(observed(spark, sf), FACTOR, {"chirps": "mode"}, SIDE, SIDE)


@book.add("agg02_static_blocks", sql("SELECT i//5 AS ci, j//5 AS cj, round(avg(elevation) + 1e-7, 6) AS elevation, round(coalesce(sum(population), 0) + 1e-7, 6) AS population FROM static GROUP BY 1, 2"))
def static_blocks(spark, sf):
    return coarsen(static(spark, sf), FACTOR, {"elevation": "mean", "population": "sum"}, SIDE, SIDE, ()).select("ci", "cj", r6("elevation"), r6("population"))


@book.add("agg04_feature_stack", sql("SELECT t, i//5 AS ci, j//5 AS cj, round(coalesce(sum(pr), 0) + 1e-7, 6) AS pr, round(coalesce(sum(chirps), 0) + 1e-7, 6) AS chirps, round(avg(tmmn) + 1e-7, 6) AS tmmn, round(avg(tmmx) + 1e-7, 6) AS tmmx, round(avg(aet) + 1e-7, 6) AS aet FROM fine GROUP BY 1, 2, 3"))
def stack(spark, sf):
    names = ["pr", "chirps", "tmmn", "tmmx", "aet"]
    return coarsen(observed(spark, sf), FACTOR, {c: method_of(c, RULES) for c in names}, SIDE, SIDE).select("t", "ci", "cj", *map(r6, names))


@book.add("agg05_variable_format", sql("SELECT t, ci, cj, feature, round(v + 1e-7, 6) AS value FROM (SELECT t, i//5 AS ci, j//5 AS cj, avg(aet) AS aet, avg(tmmx) AS tmmx FROM fine GROUP BY 1,2,3) UNPIVOT (v FOR feature IN (aet, tmmx))"))
def variable_format(spark, sf):
    x = coarsen(observed(spark, sf), FACTOR, {"aet": "mean", "tmmx": "mean"}, SIDE, SIDE)
    return x.unpivot(["t", "ci", "cj"], ["aet", "tmmx"], "feature", "value").select("t", "ci", "cj", "feature", r6("value"))


@book.add("agg06_labels", sql("SELECT i//5 AS ci, j//5 AS cj, round(min(28.525+0.05*i) + 1e-7, 6) AS lat_first, round(avg(28.525+0.05*i) + 1e-7, 6) AS lat_centre FROM cells GROUP BY 1, 2"))
def labels(spark, sf):
    x = _cells(spark, sf).withColumn("lat", F.lit(LAT0) + STEP * F.col("i"))
    return x.groupBy(F.floor(F.col("i") / FACTOR).cast("int").alias("ci"), F.floor(F.col("j") / FACTOR).cast("int").alias("cj")).agg(near(F.min_by("lat", "i"), 6).alias("lat_first"), near(F.avg("lat"), 6).alias("lat_centre"))


# weights of each method as SQL tables (i, j, ci, cj, w)
def _axes(body: str) -> str:
    """An axis table for rows, the same for columns, and their product."""
    a = body.format(x="i", c="ci", w="wi")
    b = body.format(x="j", c="cj", w="wj")
    return f"ri AS ({a}), rj AS ({b}), w AS (SELECT cells.i, cells.j, ci, cj, wi*wj AS w FROM cells JOIN ri USING (i) JOIN rj USING (j))"


#: Rounded to what the order of a sum of some 5e4 each cannot change, after a shift that no short decimal has as its half.
_APPLY = "SELECT t, i, j, CASE WHEN count(value) = any_value(n) THEN round(sum(w*value) + 1.2345678e-6, 2) END AS value FROM w JOIN coarse USING (ci, cj) JOIN (SELECT i, j, count(*) AS n FROM w GROUP BY i, j) USING (i, j) GROUP BY t, i, j"
#: The same without rounding, for what works on with it.
_PLAIN = _APPLY.replace("round(sum(w*value) + 1.2345678e-6, 2)", "sum(w*value)")
_P = "({x}-2)/5.0::DOUBLE"
_LOW = f"least(floor({_P}), 2)"
BILINEAR = _axes(f"SELECT {{x}}, CAST({_LOW} AS INT)+k AS {{c}}, CASE WHEN k=0 THEN 1-({_P}-{_LOW}) ELSE {_P}-{_LOW} END AS {{w}} FROM (SELECT DISTINCT {{x}} FROM cells), (SELECT unnest([0,1]) AS k) WHERE {{x}} BETWEEN 2 AND 17")
NEAREST = _axes(f"SELECT DISTINCT {{x}}, CAST(ceil({_P}-0.5) AS INT) AS {{c}}, 1.0::DOUBLE AS {{w}} FROM cells WHERE {{x}} BETWEEN 2 AND 17")
BOXES = _axes("SELECT DISTINCT {x}, {x}//5 AS {c}, 1.0::DOUBLE AS {w} FROM cells")
WITHIN = """w0 AS (SELECT i, j, ci, cj, sqrt((i-(5*ci+2))**2+(j-(5*cj+2))**2) AS d FROM cells, (SELECT DISTINCT ci, cj FROM coarse)), w1 AS (SELECT i, j, ci, cj, 1/greatest(d, 1e-10)**{p} AS q FROM w0 WHERE d <= 6), w AS (SELECT i, j, ci, cj, q/sum(q) OVER (PARTITION BY i, j) AS w FROM w1)"""
OVERLAP = _axes("SELECT {x}, k AS {c}, least({x}+1.0::DOUBLE, (k+1)*3.5)-greatest({x}, k*3.5) AS {w} FROM (SELECT DISTINCT {x} FROM cells), (SELECT unnest(range(6)) AS k) WHERE least({x}+1.0, (k+1)*3.5) > greatest({x}, k*3.5)").replace("w AS (SELECT cells.i", "w9 AS (SELECT cells.i") + ", w AS (SELECT i, j, ci, cj, w/sum(w) OVER (PARTITION BY i, j) AS w FROM w9)"


def _centres(spark, sf):
    return _coarse(spark, sf).select("ci", "cj").distinct().withColumn("x", FACTOR * F.col("ci") + (FACTOR - 1) / 2).withColumn("y", FACTOR * F.col("cj") + (FACTOR - 1) / 2)


def _table(spark, sf, method: str):
    cells = _cells(spark, sf)
    if method == "distance":
        return weights.within(cells, _centres(spark, sf), 6.0)
    if method == "idw":
        return weights.within(cells, _centres(spark, sf), 6.0, 2.0)
    if method == "area":
        return weights.overlap(cells, 3.5, 6, 6)
    return {"bilinear": weights.bilinear, "nearest": weights.nearest, "geographic": weights.containing, "bicubic": weights.cubic}[method](cells, FACTOR, N, N)


def _to_fine(method: str):
    def run(spark, sf):
        return weights.apply(_table(spark, sf, method), _coarse(spark, sf), "value", "value").select("t", "i", "j", F.round(F.col("value") + 1.2345678e-6, 2).alias("value"))

    return run


for _name, _method, _sql in (("grd03_bilinear", "bilinear", BILINEAR), ("grd04_nearest", "nearest", NEAREST), ("grd05_geographic", "geographic", BOXES), ("grd08_idw", "idw", WITHIN.format(p=2)), ("grd10_distance_weighted", "distance", WITHIN.format(p=1)), ("grd07_bicubic", "bicubic", None)):
    book.add(_name, sql(_APPLY, _sql) if _sql else None)(_to_fine(_method))


@book.add("grd11_area_weights", sql("SELECT i, j, ci, cj, round(w + 1e-7, 6) AS w FROM w", OVERLAP))
def area_weights(spark, sf):
    return _table(spark, sf, "area").select("i", "j", "ci", "cj", near("w", 6).alias("w"))


_G = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_TAPS = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({k - 4}, {v / sum(_G)!r}::DOUBLE)" for k, v in enumerate(_G)) + ") x(k, g))"


def _smooth_sql(source: str) -> str:
    m = lambda x: f"CASE WHEN {x}+k < 0 THEN -({x}+k)-1 WHEN {x}+k >= 20 THEN 39-({x}+k) ELSE {x}+k END"
    return f"""{_TAPS}, s0 AS (SELECT t, i, j, coalesce(value, 0) AS v, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS m FROM {source}),
s1 AS (SELECT a.t, a.i, a.j, sum(g*b.v) AS v, sum(g*b.m) AS m FROM (SELECT t, i, j, g, {m('i')} AS f FROM s0, taps) a JOIN s0 b ON b.t=a.t AND b.j=a.j AND b.i=a.f GROUP BY 1,2,3),
s2 AS (SELECT a.t, a.i, a.j, sum(g*b.v) AS v, sum(g*b.m) AS m FROM (SELECT t, i, j, g, {m('j')} AS f FROM s1, taps) a JOIN s1 b ON b.t=a.t AND b.i=a.i AND b.j=a.f GROUP BY 1,2,3)"""


@book.add("grd01_gaussian", sql("SELECT t, i, j, CASE WHEN m > 0 THEN round(v/m + 1e-7, 6) END AS value FROM s2", _smooth_sql("signal")))
def smooth(spark, sf):
    return weights.gaussian(signal(spark, sf), "value", "v", SIDE, SIDE).select("t", "i", "j", r6("v", "value"))


@book.add("grd09_gaussian_kernel", sql("SELECT t, i, j, CASE WHEN b.value IS NOT NULL AND m > 0 THEN round(v/m + 1.2345678e-6, 2) END AS value FROM s2 JOIN bi b USING (t, i, j)", BILINEAR, f"bi AS ({_PLAIN})", _smooth_sql("bi")))
def gaussian_kernel(spark, sf):
    b = weights.apply(_table(spark, sf, "bilinear"), _coarse(spark, sf), "value", "value")
    return weights.gaussian(b, "value", "v", SIDE, SIDE, restore_nulls=True).select("t", "i", "j", F.round(F.col("v") + 1.2345678e-6, 2).alias("value"))


def _sobel(source: str, out: str, v: str) -> str:
    m = lambda x, d: f"CASE WHEN {x}+{d} < 0 THEN -({x}+{d})-1 WHEN {x}+{d} >= 20 THEN 39-({x}+{d}) ELSE {x}+{d} END"
    return f"{out} AS (SELECT a.i, a.j, sum(q*(2-abs(p))*b.{v})/(8*dx) AS gx, sum(p*(2-abs(q))*b.{v})/(8*dy) AS gy FROM (SELECT i, j, p, q, {m('i', 'p')} AS fi, {m('j', 'q')} AS fj FROM {source}, stencil) a JOIN {source} b ON b.i=fi AND b.j=fj, scale GROUP BY a.i, a.j, dx, dy)"


@book.add("grd14_terrain", sql("SELECT g.i, g.j, round(degrees(atan(sqrt(g.gx**2+g.gy**2))) + 1e-7, 6) AS slope, round(CASE WHEN degrees(atan2(-g.gx, g.gy)) < 0 THEN degrees(atan2(-g.gx, g.gy))+360 ELSE degrees(atan2(-g.gx, g.gy)) END + 1e-7, 6) AS aspect, round(-(x.gx+y.gy)*1e6 + 1e-7, 6) AS curvature FROM g JOIN gxx x USING (i, j) JOIN gyy y USING (i, j)",
    "stencil AS (SELECT p, q FROM (SELECT unnest([-1,0,1]) AS p), (SELECT unnest([-1,0,1]) AS q) WHERE NOT (p = 0 AND q = 0))", "scale AS (SELECT 0.05::DOUBLE*111320.0::DOUBLE*cos(radians(28.525::DOUBLE+0.05::DOUBLE*9.5)) AS dx, 0.05::DOUBLE*111320.0::DOUBLE AS dy)", _sobel("static", "g", "elevation"), _sobel("g", "gxx", "gx"), _sobel("g", "gyy", "gy")))
def terrain(spark, sf):
    return weights.terrain(static(spark, sf), "elevation", SIDE, SIDE, LAT0, STEP).select("i", "j", near("slope", 6).alias("slope"), r6("aspect"), near(F.col("curvature") * 1e6, 6).alias("curvature"))


METHODS = ["geographic", "bilinear", "nearest", "distance", "idw"]
_TABLES = {"geographic": BOXES, "bilinear": BILINEAR, "nearest": NEAREST, "distance": WITHIN.format(p=1), "idw": WITHIN.format(p=2)}


def _corrected(spark, sf):
    """Fine predictions plus the coarse residual carried down by each method."""
    fine = observed(spark, sf).select("t", "i", "j", "value", (F.col("pr") * 100).alias("predicted"))
    c = coarsen(fine, FACTOR, {"value": "mean", "predicted": "mean"}, SIDE, SIDE).withColumn("residual", F.col("value") - F.col("predicted"))
    r = weights.apply_all({m: _table(spark, sf, m) for m in METHODS}, c, "residual", "correction")
    out = fine.join(r, ["t", "i", "j"]).select("method", "t", "i", "j", "predicted", "correction", (F.col("predicted") + F.col("correction")).alias("corrected"))
    return out, c


def _corrected_sql() -> list[str]:
    parts = ["fp AS (SELECT t, i, j, value, pr*100 AS predicted FROM fine)", "cr AS (SELECT t, i//5 AS ci, j//5 AS cj, avg(value) AS value, avg(value)-avg(predicted) AS residual FROM fp GROUP BY 1,2,3)"]
    for m, body in _TABLES.items():
        for name in ("w0", "w1", "ri", "rj"):
            body = re.sub(rf"\b{name}\b", f"{name}_{m}", body)
        body = body.replace(" w AS (SELECT", f" w_{m} AS (SELECT")
        parts += [body, f"c_{m} AS (SELECT '{m}' AS method, t, i, j, CASE WHEN count(residual) = any_value(n) THEN sum(w*residual) END AS correction FROM w_{m} JOIN cr USING (ci, cj) JOIN (SELECT i, j, count(*) AS n FROM w_{m} GROUP BY i, j) USING (i, j) GROUP BY t, i, j)"]
    return [*parts, "co AS (" + " UNION ALL ".join(f"SELECT method, t, i, j, predicted, correction, predicted+correction AS corrected FROM fp JOIN c_{m} USING (t, i, j)" for m in METHODS) + ")"]


@book.add("grd12_all_methods", sql("SELECT method, t, i, j, round(correction + 1.2345678e-6, 2) AS correction FROM co", *_corrected_sql()))
def all_methods(spark, sf):
    return _corrected(spark, sf)[0].select("method", "t", "i", "j", F.round(F.col("correction") + 1.2345678e-6, 2).alias("correction"))


_SCORES = "sc AS (SELECT method, count(*) AS n, 1-sum((value-p)**2)/any_value(v) AS r2, sqrt(avg((value-p)**2)) AS rmse, avg(abs(value-p)) AS mae, avg(p-value) AS bias FROM (SELECT method, value, p, sum((value-m)**2) OVER (PARTITION BY method) AS v FROM (SELECT method, cr.value, p, avg(cr.value) OVER (PARTITION BY method) AS m FROM (SELECT method, t, i//5 AS ci, j//5 AS cj, avg(corrected) AS p FROM co GROUP BY 1,2,3,4 HAVING avg(corrected) IS NOT NULL) JOIN cr USING (t, ci, cj))) GROUP BY method)"


def _scores(spark, sf):
    x, c = _corrected(spark, sf)
    p = coarsen(x, FACTOR, {"corrected": "mean"}, SIDE, SIDE, ("method", "t")).join(c.select("t", "ci", "cj", "value"), ["t", "ci", "cj"])
    return regression(p, "value", "corrected", ["method"])


@book.add("grd13_method_scores", sql("SELECT method, n, round(r2 + 1e-7, 6) AS r2, round(rmse + 1e-7, 6) AS rmse, round(mae + 1e-7, 6) AS mae, round(bias + 1e-7, 6) AS bias FROM sc", *_corrected_sql(), _SCORES))
def method_scores(spark, sf):
    return _scores(spark, sf).select("method", "n", r6("r2"), r6("rmse"), r6("mae"), r6("bias"))


@book.add("srt02_best_method", sql("SELECT arg_max(method, r2) AS best, round(max(r2) + 1e-7, 6) AS r2, round(max(r2)-min(r2) + 1e-7, 6) AS gain FROM sc", *_corrected_sql(), _SCORES))
def best_method(spark, sf):
    return _scores(spark, sf).agg(F.max_by("method", "r2").alias("best"), near(F.max("r2"), 6).alias("r2"), near(F.max("r2") - F.min("r2"), 6).alias("gain"))


@book.add("prj10_corrected_product", sql("SELECT t, i, j, round(predicted + 1e-7, 6) AS predicted_uncorrected, round(correction + 1e-7, 6) AS residual_correction, round(corrected + 1e-7, 6) AS downscaled FROM co WHERE method = 'geographic'", *_corrected_sql()))
def corrected_product(spark, sf):
    fine = observed(spark, sf).select("t", "i", "j", "value", (F.col("pr") * 100).alias("predicted"))
    c = coarsen(fine, FACTOR, {"value": "mean", "predicted": "mean"}, SIDE, SIDE).withColumn("residual", F.col("value") - F.col("predicted"))
    x = fine.join(weights.apply(_table(spark, sf, "geographic"), c, "residual", "correction"), ["t", "i", "j"]).withColumn("corrected", F.col("predicted") + F.col("correction"))
    return x.select("t", "i", "j", r6("predicted", "predicted_uncorrected"), r6("correction", "residual_correction"), r6("corrected", "downscaled"))
