"""Queries over grids of other spacing, names, file catalogues and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as op
from ..operators import weights
from ..sources import files
from ..sources.bind import SIDE, observed, read, sql, static
from .book import Book
from .coarse_queries import N, _coarse
from .grid_queries import POLYGON, east, latitude
from .metric_queries import rounded, rounded_sql

book = Book()
#: Rows and columns of the static source, which covers the fine grid's extent.
SOURCE = 8


def source_grid(spark, sf):
    """A static source on a grid of its own: elevation, and a class."""
    p = read(spark, sf, "part")
    x = p.groupBy((F.col("p_partkey") % SOURCE).cast("int").alias("ci"), (F.floor(F.col("p_partkey") / SOURCE) % SOURCE).cast("int").alias("cj")).agg(F.avg("p_retailprice").alias("elevation"), F.count(F.lit(1)).alias("n"))
    return x.select("ci", "cj", "elevation", (1 + F.col("n") % 17).cast("double").alias("land_cover"))


_SOURCE = f"src AS (SELECT CAST(p_partkey % {SOURCE} AS INT) AS ci, CAST((p_partkey // {SOURCE}) % {SOURCE} AS INT) AS cj, avg(p_retailprice) AS elevation, CAST(1 + count(*) % 17 AS DOUBLE) AS land_cover FROM part GROUP BY 1, 2)"


def _axis_sql(name: str, x: str, c: str, lines: str, place: str, n: int, nearest: bool) -> str:
    """Bilinear or nearest weights of one axis: lines (x) at ``place`` among n source lines."""
    if nearest:
        return f"{name} AS (SELECT {x}, CAST(ceil(p - 0.5) AS INT) AS {c}, 1.0::DOUBLE AS w FROM (SELECT {x}, {place} AS p FROM {lines}) WHERE p BETWEEN 0 AND {n - 1})"
    return f"{name} AS (SELECT {x}, CAST(least(floor(p), {n - 2}) AS INT) + k AS {c}, CASE WHEN k = 0 THEN 1 - (p - least(floor(p), {n - 2})) ELSE p - least(floor(p), {n - 2}) END AS w FROM (SELECT {x}, {place} AS p FROM {lines}), (SELECT unnest([0, 1]) AS k) WHERE p BETWEEN 0 AND {n - 1})"


def _both(tag: str, lines: tuple[str, str], place: str, n: int, nearest: bool = False) -> str:
    i, j = _axis_sql(f"a{tag}", "i", "ci", lines[0], place.format(x="i"), n, nearest), _axis_sql(f"b{tag}", "j", "cj", lines[1], place.format(x="j"), n, nearest)
    return f"{i}, {j}, w{tag} AS (SELECT i, j, ci, cj, a{tag}.w * b{tag}.w AS w FROM a{tag} CROSS JOIN b{tag} WHERE a{tag}.w * b{tag}.w <> 0)"


_PLACE = f"({{x}} - {(SIDE / SOURCE - 1) / 2!r}::DOUBLE) / {SIDE / SOURCE!r}::DOUBLE"
_LINES = ("(SELECT DISTINCT i FROM cells)", "(SELECT DISTINCT j FROM cells)")


@book.add("src06_static_on_grid", sql(rounded_sql("SELECT c.i, c.j, e.v AS elevation, l.v AS land_cover FROM cells c LEFT JOIN (SELECT i, j, sum(w*elevation) AS v FROM wl JOIN src USING (ci, cj) GROUP BY i, j) e USING (i, j) LEFT JOIN (SELECT i, j, sum(w*land_cover) AS v FROM wn JOIN src USING (ci, cj) GROUP BY i, j) l USING (i, j)", "elevation land_cover", "i j"), _SOURCE, _both("l", _LINES, _PLACE, SOURCE), _both("n", _LINES, _PLACE, SOURCE, True)))
def static_on_grid(spark, sf):
    """A continuous source is interpolated, one of classes takes the nearest; cells outside the source's centres are null."""
    cells = observed(spark, sf).select("i", "j").distinct()
    source = source_grid(spark, sf)
    place = lambda x: (F.col(x) - (SIDE / SOURCE - 1) / 2) / (SIDE / SOURCE)

    def on_grid(value: str, method: str):
        w = weights.at_places(cells, (place("i"), place("j")), SOURCE, SOURCE, method)
        return w.join(F.broadcast(source), ["ci", "cj"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col(value)).alias(value))  # the source grid: 64 rows

    return rounded(cells.join(on_grid("elevation", "bilinear"), ["i", "j"], "left").join(on_grid("land_cover", "nearest"), ["i", "j"], "left"))


_FINER = 5
_REFINE = f"{{x}} * ({N - 1} / {N * _FINER - 1}.0::DOUBLE)"
_FINE_LINES = (f"(SELECT CAST(unnest(range({N * _FINER})) AS INT) AS i)", f"(SELECT CAST(unnest(range({N * _FINER})) AS INT) AS j)")
_REFINED = "SELECT t, i, j, CASE WHEN count(value) = count(*) AND count(*) = any_value(n) THEN sum(w*value) END AS value FROM w{tag} JOIN coarse USING (ci, cj) JOIN (SELECT i, j, count(*) AS n FROM w{tag} GROUP BY i, j) USING (i, j) GROUP BY t, i, j"


def _refined(method: str):
    def run(spark, sf):
        c = _coarse(spark, sf)
        return rounded(weights.apply(weights.refine(c, _FINER, N, N, method), c, "value", "value"))

    return run


for _name, _method in (("grd02_refine_linear", "bilinear"), ("grd02_refine_nearest", "nearest")):
    book.add(_name, sql(rounded_sql(_REFINED.format(tag="r"), "value", "t i j"), _both("r", _FINE_LINES, _REFINE, N, _method == "nearest")))(_refined(_method))
book.add("grd02_refine_cubic")(_refined("cubic"))


@book.add("join10_grid_match", sql(rounded_sql("SELECT t, ci, cj, CASE WHEN count(pr) = 4 THEN avg(pr) END AS pr FROM signal JOIN (SELECT unnest(range(5)) AS ci) ON i BETWEEN 4*ci+1 AND 4*ci+2 JOIN (SELECT unnest(range(5)) AS cj) ON j BETWEEN 4*cj+1 AND 4*cj+2 GROUP BY t, ci, cj", "pr", "t ci cj")))
def grid_match(spark, sf):
    """A fine field at the centres of a coarse grid of factor 4, which lie between fine cells."""
    from ..sources.bind import signal

    fine = signal(spark, sf).select("t", F.col("i").alias("ci"), F.col("j").alias("cj"), "pr")
    centres = fine.select((F.col("ci") / 4).cast("int").alias("i"), (F.col("cj") / 4).cast("int").alias("j")).distinct()
    w = weights.at_places(centres, (4 * F.col("i") + 1.5, 4 * F.col("j") + 1.5), SIDE, SIDE)
    return rounded(weights.apply(w, fine, "pr", "pr").select("t", F.col("i").cast("long").alias("ci"), F.col("j").cast("long").alias("cj"), "pr"))


@book.add("agg07_factor", sql("SELECT CAST(round((max(ci_step))/max(fine_step)) AS INT) AS factor FROM (SELECT (max(lat)-min(lat))/(count(DISTINCT i)-1) AS fine_step, 5*(max(lat)-min(lat))/(count(DISTINCT i)-1) AS ci_step FROM (SELECT i, 28.525+0.05*i AS lat FROM cells))"))
def factor(spark, sf):
    x = observed(spark, sf).select("i", latitude().alias("lat")).distinct()
    step = x.agg(((F.max("lat") - F.min("lat")) / (F.count(F.lit(1)) - 1)).alias("s")).first()["s"]
    return spark.createDataFrame([(op.aggregation_factor(5 * step, step),)], "factor int")


@book.add("src13_inspection_axes", sql(rounded_sql("SELECT m.t, c.i, c.j, 28.525+0.05*c.i AS lat, -113.975+0.05*c.j AS lon FROM cells c CROSS JOIN (SELECT DISTINCT t FROM fine) m", "lat lon", "t i j")))
def inspection_axes(spark, sf):
    x = observed(spark, sf).withColumn("lat", latitude()).withColumn("lon", east())
    return rounded(op.axes(x, spark, SIDE, SIDE, 12, (28.525, 29.475, -113.975, -113.025)).select("t", "i", "j", "lat", "lon"))


@book.add("prj07_matched_names", sql(rounded_sql("SELECT i, j, population AS soil_population, elevation, CAST(land_cover AS DOUBLE) AS soil_land_cover FROM static", "soil_population elevation soil_land_cover", "i j")))
def matched_names(spark, sf):
    """Static columns under the names of training, found with or without their prefix, in its order."""
    x = static(spark, sf).withColumn("land_cover", F.col("land_cover").cast("double"))
    names = op.matched(x.columns, ["soil_population", "elevation", "soil_land_cover", "soil_absent"])
    return rounded(x.select("i", "j", *[F.col(c).alias(n) for n, c in names.items()]))


@book.add("prj08_base_subset", sql(rounded_sql("SELECT t, i, j, pr, aet FROM fine", "pr aet", "t i j")))
def base_subset(spark, sf):
    return rounded(op.base_subset(observed(spark, sf), ["pr", "aet", "tmmx_anom"], ["t", "i", "j"], 2))


#: A second ring, apart from the first.
SECOND = [(-113.3, 28.525), (-113.025, 28.525), (-113.025, 28.8), (-113.2, 28.85)]


def _ring_sql(ring) -> str:
    crossing, on = [], []
    for x1, y1, x2, y2 in op.edges_of(ring):
        if y1 != y2:
            crossing.append(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < {x1} + (lat-({y1}))*(({x2}-({x1}))/({y2}-({y1}))) THEN 1 ELSE 0 END)")
        on.append(f"(abs((lon-({x1}))*({y2}-({y1}))-(lat-({y1}))*({x2}-({x1}))) < 1e-12 AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
    return f"(({' OR '.join(on)}) OR ({' + '.join(crossing)}) % 2 = 1)"


@book.add("flt07_polygon_union", sql(f"SELECT i, j, {_ring_sql(POLYGON)} OR {_ring_sql(SECOND)} AS inside FROM (SELECT i, j, 28.525::DOUBLE+0.05::DOUBLE*i AS lat, -113.975::DOUBLE+0.05::DOUBLE*j AS lon FROM cells)"))
def polygon_union(spark, sf):
    cells = observed(spark, sf).select("i", "j").distinct().withColumn("lat", latitude()).withColumn("lon", east())
    return op.in_any_polygon(cells, [POLYGON, SECOND]).select("i", "j", "inside")


@book.add("src03_file_catalogue", sql("""SELECT source, variable, t, max(file) AS file FROM (SELECT s.source, s.variable, m.t, f.file FROM (SELECT DISTINCT source, variable FROM fl) s CROSS JOIN (SELECT DISTINCT t FROM fine) m
LEFT JOIN fl f ON f.source = s.source AND f.variable = s.variable AND f.t = m.t) GROUP BY 1, 2, 3""", """fl AS (SELECT 'dated' AS source, 'pr' AS variable, strftime(l_shipdate, '%Y%m') || '.tif' AS file, CAST((year(l_shipdate)-1995)*12+month(l_shipdate)-1 AS INT) AS t FROM lineitem WHERE l_shipdate >= '1995-01-01' AND month(l_shipdate) <> 7
UNION SELECT 'counted', 'aet', CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS VARCHAR) || '.tif', CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS INT) FROM orders WHERE o_orderdate >= '1995-01-01')"""))
def file_catalogue(spark, sf):
    """Files named by date and by month number, on the spine of all months; July's dated files are absent."""
    line, order = read(spark, sf, "lineitem").where("l_shipdate >= '1995-01-01' and month(l_shipdate) <> 7"), read(spark, sf, "orders").where("o_orderdate >= '1995-01-01'")
    dated = line.select(F.lit("dated").alias("source"), F.lit("pr").alias("variable"), F.concat(F.date_format("l_shipdate", "yyyyMM"), F.lit(".tif")).alias("file")).distinct()
    number = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    counted = order.select(F.lit("counted").alias("source"), F.lit("aet").alias("variable"), F.concat(number.cast("string"), F.lit(".tif")).alias("file")).distinct()
    return files.catalogue(dated.unionByName(counted), observed(spark, sf).select("t"), 1995)
