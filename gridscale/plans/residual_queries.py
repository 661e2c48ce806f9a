"""Queries over all eight ways from coarse residuals to the fine grid, their scores and gains."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import weights
from ..operators.coarsen import coarsen
from ..operators.metrics import regression
from ..sources.bind import FACTOR, SIDE, observed, sql
from .book import Book
from .coarse_queries import BILINEAR, BOXES, N, NEAREST, WITHIN, _centres

book = Book()
#: Added before rounding: no short decimal fraction comes to an exact half with it.
SHIFT = 1.2345678e-6


def told(df, digits: int = 4):
    """Floating columns rounded to ``digits``, which is coarser than what the order of a sum can change."""
    return df.select(*[F.round(F.col(n) + SHIFT, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def told_sql(body: str, floats: str, plain: str, digits: int = 4) -> str:
    return f"SELECT {', '.join([f'round({c} + {SHIFT!r}, {digits}) AS {c}' for c in floats.split()] + plain.split())} FROM ({body})"


METHODS = ["area", "bicubic", "bilinear", "distance", "gaussian", "geographic", "idw", "nearest"]


def residuals(spark, sf):
    """Fine values with a prediction, and the coarse residual of its block means."""
    fine = observed(spark, sf).select("t", "i", "j", "value", (F.col("pr") * 100).alias("predicted"))
    c = coarsen(fine, FACTOR, {"value": "mean", "predicted": "mean"}, SIDE, SIDE).withColumn("residual", F.col("value") - F.col("predicted"))
    return fine, c


def tables(spark, sf) -> dict:
    cells, centres = observed(spark, sf).select("i", "j").distinct(), _centres(spark, sf)
    bilinear = weights.bilinear(cells, FACTOR, N, N)
    return {
        "area": weights.overlap(cells, float(FACTOR), N, N), "bicubic": weights.cubic(cells, FACTOR, N, N), "bilinear": bilinear, "distance": weights.within(cells, centres, 6.0),
        "gaussian": weights.smoothed(bilinear, cells, SIDE, SIDE), "geographic": weights.containing(cells, FACTOR, N, N), "idw": weights.within(cells, centres, 6.0, 2.0), "nearest": weights.nearest(cells, FACTOR, N, N),
    }


def corrected(spark, sf):
    """(method, t, i, j, value, predicted, correction, corrected) for every method, and the coarse table."""
    fine, c = residuals(spark, sf)
    x = fine.join(weights.apply_all(tables(spark, sf), c, "residual", "correction"), ["t", "i", "j"])
    return x.withColumn("corrected", F.col("predicted") + F.col("correction")), c


def _renamed(body: str, m: str) -> str:
    import re

    for name in ("w0", "w1", "ri", "rj"):
        body = re.sub(rf"\b{name}\b", f"{name}_{m}", body)
    return body.replace(" w AS (SELECT", f" w_{m} AS (SELECT")


def _cubic_axis(x: str, c: str, w: str) -> str:
    p = f"(({x}-2)/5.0::DOUBLE)"
    low = f"least(floor({p}), 2)"
    f = f"({p}-{low})"
    taps = [(-1, f"-0.5*{f}+{f}*{f}-0.5*{f}**3"), (0, f"1-2.5*{f}*{f}+1.5*{f}**3"), (1, f"0.5*{f}+2*{f}*{f}-1.5*{f}**3"), (2, f"-0.5*{f}*{f}+0.5*{f}**3")]
    rows = " UNION ALL ".join(f"SELECT {x}, CAST(greatest(least({low}+({k}), 3), 0) AS INT) AS {c}, {v} AS {w} FROM (SELECT DISTINCT {x} FROM cells) WHERE {x} BETWEEN 2 AND 17" for k, v in taps)
    return f"SELECT {x}, {c}, sum({w}) AS {w} FROM ({rows}) GROUP BY 1, 2"


_CUBIC = f"ri AS ({_cubic_axis('i', 'ci', 'wi')}), rj AS ({_cubic_axis('j', 'cj', 'wj')}), w AS (SELECT cells.i, cells.j, ci, cj, wi*wj AS w FROM cells JOIN ri USING (i) JOIN rj USING (j))"
_G = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_GTAPS = "gt AS (SELECT * FROM (VALUES " + ", ".join(f"({k - 4}, {v / sum(_G)!r}::DOUBLE)" for k, v in enumerate(_G)) + ") x(k, g))"


def _mirror(x: str) -> str:
    return f"CASE WHEN {x}+k < 0 THEN -({x}+k)-1 WHEN {x}+k >= 20 THEN 39-({x}+k) ELSE {x}+k END"


_GAUSSIAN = [
    _GTAPS,
    f"g1 AS (SELECT a.i, a.j, ci, cj, sum(g*w) AS w FROM (SELECT i, j, g, {_mirror('i')} AS f FROM cells, gt) a JOIN w_bilinear b ON b.i = a.f AND b.j = a.j GROUP BY 1, 2, 3, 4)",
    f"g2 AS (SELECT a.i, a.j, ci, cj, sum(g*w) AS w FROM (SELECT i, j, g, {_mirror('j')} AS f FROM cells, gt) a JOIN g1 b ON b.j = a.f AND b.i = a.i GROUP BY 1, 2, 3, 4)",
    "m0 AS (SELECT i, j, CASE WHEN EXISTS (SELECT 1 FROM w_bilinear b WHERE b.i = c.i AND b.j = c.j) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM cells c)",
    f"m1 AS (SELECT a.i, a.j, sum(g*m) AS m FROM (SELECT i, j, g, {_mirror('i')} AS f FROM cells, gt) a JOIN m0 b ON b.i = a.f AND b.j = a.j GROUP BY 1, 2)",
    f"m2 AS (SELECT a.i, a.j, sum(g*m) AS m FROM (SELECT i, j, g, {_mirror('j')} AS f FROM cells, gt) a JOIN m1 b ON b.j = a.f AND b.i = a.i GROUP BY 1, 2)",
    "w_gaussian AS (SELECT g2.i, g2.j, ci, cj, w/m2.m AS w FROM g2 JOIN m2 USING (i, j) JOIN m0 USING (i, j) WHERE m0.m > 0)",
]
CO = [
    "fp AS (SELECT t, i, j, value, pr*100 AS predicted FROM fine)",
    "cr AS (SELECT t, i//5 AS ci, j//5 AS cj, avg(value) AS value, avg(predicted) AS predicted, avg(value)-avg(predicted) AS residual FROM fp GROUP BY 1, 2, 3)",
    *[_renamed(body, m) for m, body in (("area", BOXES), ("bicubic", _CUBIC), ("bilinear", BILINEAR), ("distance", WITHIN.format(p=1)), ("geographic", BOXES), ("idw", WITHIN.format(p=2)), ("nearest", NEAREST))],
    *_GAUSSIAN,
    "aw AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, i, j, ci, cj, w FROM w_{m}" for m in METHODS) + ")",
    "ac AS (SELECT method, t, i, j, CASE WHEN count(residual) = any_value(n) THEN sum(w*residual) END AS correction FROM aw JOIN cr USING (ci, cj) JOIN (SELECT method, i, j, count(*) AS n FROM aw GROUP BY ALL) USING (method, i, j) GROUP BY method, t, i, j)",
    "co AS (SELECT method, t, i, j, value, predicted, correction, predicted+correction AS corrected FROM fp JOIN ac USING (t, i, j))",
]


@book.add("grd12_eight_methods", sql(told_sql("SELECT method, t, i, j, correction FROM co", "correction", "method t i j", 2), *CO))
def eight_methods(spark, sf):
    return told(corrected(spark, sf)[0].select("method", "t", "i", "j", "correction"), 2)


_PAIRS = "pa AS (SELECT method, t, ci, cj, cr.value, before, after FROM (SELECT method, t, i//5 AS ci, j//5 AS cj, avg(predicted) AS before, avg(corrected) AS after FROM co GROUP BY 1, 2, 3, 4) JOIN cr USING (t, ci, cj) WHERE cr.value IS NOT NULL AND before IS NOT NULL AND after IS NOT NULL)"


def pairs(spark, sf):
    """(method, t, ci, cj, value, before, after): block means of both products and the signal, under one mask."""
    x, c = corrected(spark, sf)
    p = coarsen(x, FACTOR, {"predicted": "mean", "corrected": "mean"}, SIDE, SIDE, ("method", "t")).withColumnsRenamed({"predicted": "before", "corrected": "after"})
    return p.join(c.select("t", "ci", "cj", "value"), ["t", "ci", "cj"]).dropna(subset=["value", "before", "after"])


@book.add("join06_before_after", sql(told_sql("SELECT method, t, ci, cj, value, before, after FROM pa WHERE t IN (SELECT t FROM (SELECT DISTINCT t FROM pa) ORDER BY t LIMIT 20)", "value before after", "method t ci cj", 2), *CO, _PAIRS))
def before_after(spark, sf):
    """The first 20 common months, as the pairing of several methods takes."""
    p = pairs(spark, sf)
    months = p.select("t").distinct().orderBy("t").limit(20)
    return told(p.join(F.broadcast(months), "t").select("method", "t", "ci", "cj", "value", "before", "after"), 2)


_M = "SELECT method, count(*) AS n, 1-sum((value-{p})**2)/any_value(v) AS r2, sqrt(avg((value-{p})**2)) AS rmse, avg(abs(value-{p})) AS mae, avg({p}-value) AS bias FROM pa JOIN (SELECT method, var_pop(value)*count(*) AS v FROM pa GROUP BY method) USING (method) GROUP BY method"
_GAINS = [f"mb AS ({_M.format(p='before')})", f"ma AS ({_M.format(p='after')})"]


def gains(spark, sf):
    p = pairs(spark, sf)
    before, after = regression(p, "value", "before", ["method"]), regression(p, "value", "after", ["method"])
    b = before.select("method", F.col("r2").alias("r2_0"), F.col("rmse").alias("rmse_0"), F.col("mae").alias("mae_0"))
    return after.join(b, "method").select("method", "n", "r2", "rmse", "mae", "bias", (F.col("r2") - F.col("r2_0")).alias("gain_r2"), (F.col("rmse_0") - F.col("rmse")).alias("gain_rmse"), (F.col("mae_0") - F.col("mae")).alias("gain_mae"))


_GAIN = "SELECT method, a.n, a.r2, a.rmse, a.mae, a.bias, a.r2-b.r2 AS gain_r2, b.rmse-a.rmse AS gain_rmse, b.mae-a.mae AS gain_mae FROM ma a JOIN mb b USING (method)"


@book.add("agg37_improvement", sql(told_sql(_GAIN, "r2 rmse mae bias gain_r2 gain_rmse gain_mae", "method n", 3), *CO, _PAIRS, *_GAINS))
def improvement(spark, sf):
    return told(gains(spark, sf), 3)


@book.add("grd13_eight_scores", sql(told_sql("SELECT method, n, CASE WHEN n > 10 THEN r2 END AS r2, CASE WHEN n > 10 THEN rmse END AS rmse, CASE WHEN n > 10 THEN mae END AS mae, CASE WHEN n > 10 THEN bias END AS bias FROM ma", "r2 rmse mae bias", "method n", 3), *CO, _PAIRS, *_GAINS))
def eight_scores(spark, sf):
    g = gains(spark, sf)
    return told(g.select("method", "n", *[F.when(F.col("n") > 10, F.col(c)).alias(c) for c in ("r2", "rmse", "mae", "bias")]), 3)


@book.add("pipe09_bake_off", sql(told_sql("SELECT arg_max(method, (round(r2, 6), method)) AS best, max(r2) AS r2, max(r2) - any_value(b0) AS gain FROM ma, (SELECT max(r2) AS b0 FROM mb WHERE method = 'geographic')", "r2 gain", "best", 3), *CO, _PAIRS, *_GAINS))
def bake_off(spark, sf):
    """The best method by its score, and what it gains over the uncorrected product; of equal ones the last by name."""
    g = gains(spark, sf)
    before = g.where("method = 'geographic'").select((F.col("r2") - F.col("gain_r2")).alias("b0"))
    best = g.agg(F.max_by("method", F.struct(F.round("r2", 6), "method")).alias("best"), F.max("r2").alias("r2"))
    return told(best.crossJoin(F.broadcast(before)).select("best", "r2", (F.col("r2") - F.col("b0")).alias("gain")), 3)  # one row each


def _spline_axis(x: str, c: str, w: str) -> str:
    p = f"(({x}-2)/5.0::DOUBLE)"
    low = f"least(floor({p}), 2)"
    f = f"({p}-{low})"
    taps = [(-1, f"(1-{f})**3/6"), (0, f"(4-6*{f}**2+3*{f}**3)/6"), (1, f"(1+3*{f}+3*{f}**2-3*{f}**3)/6"), (2, f"{f}**3/6")]
    rows = " UNION ALL ".join(f"SELECT {x}, {low}+({k}) AS k, {v} AS b FROM (SELECT DISTINCT {x} FROM cells) WHERE {x} BETWEEN 2 AND 17" for k, v in taps)
    mirrored = "CASE WHEN z.k < 0 THEN -z.k WHEN z.k > 3 THEN 6 - z.k ELSE z.k END"
    return f"SELECT {x}, m AS {c}, sum(b*v) AS {w} FROM ({rows}) z JOIN iv ON iv.k = {mirrored} GROUP BY 1, 2"


# the inverse of the band (1, 4, 1) / 6 with mirrored ends, for four lines
_INVERSE = "iv AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {m}, {v!r}::DOUBLE)" for k, r in enumerate(weights.spline_inverse(4)) for m, v in enumerate(r)) + ") x(k, m, v))"
_SPLINE = f"sri AS ({_spline_axis('i', 'ci', 'wi')}), srj AS ({_spline_axis('j', 'cj', 'wj')}), w_spline AS (SELECT cells.i, cells.j, ci, cj, wi*wj AS w FROM cells JOIN sri USING (i) JOIN srj USING (j))"


_CARRIED = """sc AS (SELECT t, i, j, CASE WHEN count(residual) = any_value(n) THEN sum(w*residual) END AS correction
FROM w_spline JOIN cr USING (ci, cj) JOIN (SELECT i, j, count(*) AS n FROM w_spline GROUP BY ALL) USING (i, j) GROUP BY t, i, j)"""


@book.add("grd07_spline", sql(told_sql("SELECT t, i, j, correction FROM sc", "correction", "t i j", 2), CO[0], CO[1], _INVERSE, _SPLINE, _CARRIED))
def spline_correction(spark, sf):
    """The coarse residual carried down by a cubic B-spline that goes through the coarse values."""
    fine, c = residuals(spark, sf)
    table = weights.spline(fine.select("i", "j").distinct(), FACTOR, SIDE // FACTOR, SIDE // FACTOR)
    return told(weights.apply(table, c, "residual", "correction").select("t", "i", "j", "correction"), 2)


_SIDES = "(i-2)/5.0::DOUBLE BETWEEN a AND a+1 AND (j-2)/5.0::DOUBLE BETWEEN b AND b+1"
_CASES = [(0, 0, "WHEN 13 THEN 1-u WHEN 11 THEN 1-v WHEN 7 THEN 1-u-v"), (1, 0, "WHEN 13 THEN u-v WHEN 7 THEN u WHEN 14 THEN 1-v"), (0, 1, "WHEN 11 THEN v-u WHEN 7 THEN v WHEN 14 THEN 1-u"), (1, 1, "WHEN 13 THEN v WHEN 11 THEN u WHEN 14 THEN u+v-1")]
_TRIANGLES = [
    "kn AS (SELECT DISTINCT ci, cj FROM cr WHERE residual IS NOT NULL)",
    "sq AS (SELECT a, b, sum(bit) AS there FROM (SELECT ci-p AS a, cj-q AS b, bit FROM kn, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) c(p, q, bit)) GROUP BY 1, 2)",
    f"pl AS (SELECT i, j, a, b, there, (i-2)/5.0::DOUBLE-a AS u, (j-2)/5.0::DOUBLE-b AS v FROM cells, sq WHERE {_SIDES})",
    "tk AS (SELECT i, j, a, b, u, v, CASE WHEN there IN (13, 15) AND u >= v THEN 13 WHEN there IN (11, 15) AND u <= v THEN 11 WHEN there = 7 AND u+v <= 1 THEN 7 WHEN there = 14 AND u+v >= 1 THEN 14 END AS k FROM pl)",
    "t1 AS (SELECT * FROM tk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY a, b) = 1)",
    "w_tri AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT i, j, a+{p} AS ci, b+{q} AS cj, CASE k {c} ELSE 0 END AS w FROM t1" for p, q, c in _CASES) + ") WHERE abs(w) > 1e-9)",
    _CARRIED.replace("w_spline", "w_tri"),
]


@book.add("grd08_triangulated", sql(told_sql("SELECT t, i, j, correction FROM sc", "correction", "t i j", 2), CO[0], CO[1], *_TRIANGLES))
def triangulated_correction(spark, sf):
    """The coarse residual carried down linearly in the triangles of the coarse cells that have one in any month."""
    fine, c = residuals(spark, sf)
    table = weights.triangulated(fine.select("i", "j").distinct(), c.where("residual IS NOT NULL"), FACTOR)
    return told(weights.apply(table, c, "residual", "correction").select("t", "i", "j", "correction"), 2)
