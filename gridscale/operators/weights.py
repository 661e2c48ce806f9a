"""From coarse to fine by time-independent weight tables W(i, j, ci, cj, w), and kernels on the fine grid.

A method makes one table over cells; applying it is one equi-join on the coarse cell and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis(cells: DataFrame, index: str) -> DataFrame:
    """The distinct lines of one axis."""
    return cells.select(index).distinct()


def _product(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Weights of both axes multiplied; the axis tables have a few rows for each line of the grid."""
    return cells.select("i", "j").join(F.broadcast(rows), "i").join(F.broadcast(columns), "j").select("i", "j", "ci", "cj", (F.col("wi") * F.col("wj")).alias("w"))


def _place(index: str, factor: int) -> Column:
    """Position among coarse centres, in coarse steps."""
    return (F.col(index) - (factor - 1) / 2) / factor


def bilinear(cells: DataFrame, factor: int, n_rows: int, n_columns: int) -> DataFrame:
    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        x = _place(index, factor)
        low = F.least(F.floor(x), F.lit(n - 2)).cast("int")
        pair = F.array(F.struct(low.alias(out), (1 - (x - low)).alias(w)), F.struct((low + 1).alias(out), (x - low).alias(w)))
        return axis(cells, index).where(x.between(0, n - 1)).select(index, F.explode(pair).alias("p")).select(index, "p.*")

    return _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))


def cubic(cells: DataFrame, factor: int, n_rows: int, n_columns: int) -> DataFrame:
    """Separable four-tap cubic (Catmull-Rom) weights; taps beyond the grid repeat its edge."""

    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        x = _place(index, factor)
        low = F.least(F.floor(x), F.lit(n - 2)).cast("int")
        f = x - low
        taps = [-0.5 * f + f * f - 0.5 * f**3, 1 - 2.5 * f * f + 1.5 * f**3, 0.5 * f + 2 * f * f - 1.5 * f**3, -0.5 * f * f + 0.5 * f**3]
        four = F.array(*[F.struct(F.greatest(F.least(low + k - 1, F.lit(n - 1)), F.lit(0)).alias(out), t.alias(w)) for k, t in enumerate(taps)])
        x_rows = axis(cells, index).where(x.between(0, n - 1)).select(index, F.explode(four).alias("p")).select(index, "p.*")
        return x_rows.groupBy(index, out).agg(F.sum(w).alias(w))

    return _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))


def nearest(cells: DataFrame, factor: int, n_rows: int, n_columns: int) -> DataFrame:
    """The nearest centre, the lower one at a midpoint; nothing outside the centres."""

    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        x = _place(index, factor)
        return axis(cells, index).where(x.between(0, n - 1)).select(index, F.ceil(x - 0.5).cast("int").alias(out), F.lit(1.0).alias(w))

    return _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))


def containing(cells: DataFrame, factor: int, n_rows: int, n_columns: int) -> DataFrame:
    """The coarse box that holds the cell, edges included; the later box wins a tie."""

    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        box = F.floor((F.col(index) + 0.5) / factor).cast("int")
        return axis(cells, index).where((F.col(index) >= 0) & (F.col(index) < n * factor)).select(index, F.least(box, F.lit(n - 1)).alias(out), F.lit(1.0).alias(w))

    return _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))


def overlap(cells: DataFrame, width: float, n_rows: int, n_columns: int) -> DataFrame:
    """Share of each cell's area in coarse boxes of ``width`` cells, normalised."""

    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        lo, hi = F.col(index).cast("double"), F.col(index) + 1.0
        x = axis(cells, index).withColumn(out, F.explode(F.sequence(F.floor(lo / width).cast("int"), F.least(F.ceil(hi / width).cast("int") - 1, F.lit(n - 1)))))
        return x.select(index, out, (F.least(hi, (F.col(out) + 1) * width) - F.greatest(lo, F.col(out) * width)).alias(w)).where(F.col(w) > 0)

    table = _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))
    total = table.groupBy("i", "j").agg(F.sum("w").alias("s"))
    return table.join(total, ["i", "j"]).withColumn("w", F.col("w") / F.col("s")).drop("s")


def within(cells: DataFrame, centres: DataFrame, radius: float, power: float = 1.0) -> DataFrame:
    """All centres (ci, cj, x, y, in cell units) within ``radius`` of a cell, weighted 1 / d^power and normalised.

    Cells and centres meet in square buckets of the radius, a cell in its bucket and the eight around it.
    """
    bucket = lambda c: F.floor(F.col(c) / radius)
    around = F.sequence(F.lit(-1), F.lit(1))
    near = cells.select("i", "j").withColumn("bx", F.explode(F.transform(around, lambda k: bucket("i") + k))).withColumn("by", F.explode(F.transform(around, lambda k: bucket("j") + k)))
    d = F.sqrt((F.col("i") - F.col("x")) ** 2 + (F.col("j") - F.col("y")) ** 2)
    met = near.join(centres.withColumn("bx", bucket("x")).withColumn("by", bucket("y")), ["bx", "by"]).where(d <= radius)
    w = met.select("i", "j", "ci", "cj", (1 / F.greatest(d, F.lit(1e-10)) ** power).alias("w"))
    total = w.groupBy("i", "j").agg(F.sum("w").alias("s"))
    return w.join(total, ["i", "j"]).withColumn("w", F.col("w") / F.col("s")).drop("s")


def triangulated(cells: DataFrame, known: DataFrame, factor: int) -> DataFrame:
    """Barycentric weights in the triangles of the ``known`` coarse centres (ci, cj), so planes come out exactly.

    A square of four known centres is cut along its diagonal from the low to the high corner, one of three is a single
    triangle; all of these are Delaunay triangles. Larger triangles across gaps are not made: what lies in none, beyond
    the hull or right around a missing centre, gets nothing. Squares are made on the coarse grid and met by an
    equi-join; a cell on an edge of several squares takes the lowest that has a triangle there.
    """
    corners = ((0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8))
    of = F.array(*[F.struct((F.col("ci") - p).alias("a"), (F.col("cj") - q).alias("b"), F.lit(bit).alias("bit")) for p, q, bit in corners])
    squares = known.select("ci", "cj").distinct().select(F.explode(of).alias("s")).groupBy("s.a", "s.b").agg(F.sum("s.bit").alias("there"))
    sides = lambda x: F.explode(F.array_distinct(F.array(F.floor(x).cast("int"), (F.ceil(x) - 1).cast("int"))))
    placed = cells.select("i", "j").distinct().select("i", "j", _place("i", factor).alias("x"), _place("j", factor).alias("y"))
    placed = placed.select("*", sides(F.col("x")).alias("a")).select("*", sides(F.col("y")).alias("b"))
    u, v, there = F.col("x") - F.col("a"), F.col("y") - F.col("b"), F.col("there")

    def triangle(*taps: tuple[int, int, Column]) -> Column:
        return F.array(*[F.struct((F.col("a") + p).alias("ci"), (F.col("b") + q).alias("cj"), w.alias("w")) for p, q, w in taps])

    chosen = (
        F.when(there.isin(13, 15) & (u >= v - 1e-9), triangle((0, 0, 1 - u), (1, 0, u - v), (1, 1, v)))
        .when(there.isin(11, 15) & (u <= v + 1e-9), triangle((0, 0, 1 - v), (0, 1, v - u), (1, 1, u)))
        .when((there == 7) & (u + v <= 1 + 1e-9), triangle((0, 0, 1 - u - v), (1, 0, u), (0, 1, v)))
        .when((there == 14) & (u + v >= 1 - 1e-9), triangle((1, 0, 1 - v), (0, 1, 1 - u), (1, 1, u + v - 1)))
    )
    met = placed.join(squares, ["a", "b"]).select("i", "j", F.struct("a", "b", chosen.alias("taps")).alias("s")).where("s.taps IS NOT NULL")
    lowest = met.groupBy("i", "j").agg(F.min("s").alias("s"))
    return lowest.select("i", "j", F.explode("s.taps").alias("p")).select("i", "j", "p.ci", "p.cj", "p.w").where(F.abs("w") > 1e-9)


def spline_inverse(n: int) -> list[list[float]]:
    """The B-spline prefilter of ``n`` samples as a matrix, coefficients from values: the inverse of the band (1, 4, 1) / 6
    with mirrored ends, column by column by elimination along the band."""
    if n == 1:
        return [[1.0]]
    lower, upper = [1 / 6] * (n - 1), [1 / 6] * (n - 1)
    upper[0], lower[-1] = 2 / 6, 2 / 6
    diagonal = [4 / 6] * n
    for k in range(1, n):
        diagonal[k] -= lower[k - 1] / diagonal[k - 1] * upper[k - 1]
    out = [[0.0] * n for _ in range(n)]
    for m in range(n):
        v = [float(k == m) for k in range(n)]
        for k in range(1, n):
            v[k] -= lower[k - 1] / (diagonal[k - 1]) * v[k - 1]
        v[-1] /= diagonal[-1]
        for k in range(n - 2, -1, -1):
            v[k] = (v[k] - upper[k] * v[k + 1]) / diagonal[k]
        for k in range(n):
            out[k][m] = v[k]
    return out


def spline(cells: DataFrame, factor: int, n_rows: int, n_columns: int) -> DataFrame:
    """Separable cubic B-spline weights with the prefilter folded in, so the surface goes through the coarse values. Taps
    of an axis fade by 0.27 a line; those below 1e-9 are left out, so a fine line has some 35 at most."""
    spark = cells.sparkSession

    def one(index: str, out: str, w: str, n: int) -> DataFrame:
        inverse, rows = spline_inverse(n), []
        for line in range(n * factor):  # the axis
            x = (line - (factor - 1) / 2) / factor
            if 0 <= x <= n - 1:
                low = min(int(x), max(n - 2, 0))
                f = x - low
                basis = ((1 - f) ** 3 / 6, (4 - 6 * f * f + 3 * f**3) / 6, (1 + 3 * f + 3 * f * f - 3 * f**3) / 6, f**3 / 6)
                places = [abs(low + k) if low + k <= n - 1 else 2 * (n - 1) - low - k for k in (-1, 0, 1, 2)] if n > 1 else [0] * 4
                for m in range(max(0, low - 20), min(n, low + 21)):
                    v = sum(b * inverse[k][m] for b, k in zip(basis, places, strict=True))
                    if abs(v) > 1e-9:
                        rows.append((line, m, v))
        return spark.createDataFrame(rows, f"{index} int, {out} int, {w} double")

    return _product(cells, one("i", "ci", "wi", n_rows), one("j", "cj", "wj", n_columns))



def _index_axis(cells: DataFrame, index: str, out: str, w: str, place: Column, n: int, method: str) -> DataFrame:
    """Weights of one axis whose lines lie at ``place`` among ``n`` source lines; nothing outside them."""
    x = axis(cells, index).withColumn("_x", place).where(F.col("_x").between(0, n - 1))
    if method == "nearest":
        return x.select(index, F.ceil(F.col("_x") - 0.5).cast("int").alias(out), F.lit(1.0).alias(w))
    low = F.least(F.floor("_x"), F.lit(max(n - 2, 0))).cast("int")
    f = F.col("_x") - low
    if method == "bilinear":
        taps = [(0, 1 - f), (1, f)]
    else:
        taps = list(zip((-1, 0, 1, 2), (-0.5 * f + f * f - 0.5 * f**3, 1 - 2.5 * f * f + 1.5 * f**3, 0.5 * f + 2 * f * f - 1.5 * f**3, -0.5 * f * f + 0.5 * f**3), strict=True))
    some = F.array(*[F.struct(F.greatest(F.least(low + k, F.lit(n - 1)), F.lit(0)).alias(out), v.alias(w)) for k, v in taps])
    return x.select(index, F.explode(some).alias("p")).select(index, "p.*").groupBy(index, out).agg(F.sum(w).alias(w)).where(F.col(w) != 0)


def at_places(cells: DataFrame, places: tuple[Column, Column], n_rows: int, n_columns: int, method: str = "bilinear") -> DataFrame:
    """Weights of source lines for ``cells`` (i, j) that lie at ``places`` (columns of i and of j) in the source's index space."""
    return _product(cells, _index_axis(cells, "i", "ci", "wi", places[0], n_rows, method), _index_axis(cells, "j", "cj", "wj", places[1], n_columns, method))


def refine(coarse_cells: DataFrame, factor: int, n_rows: int, n_columns: int, method: str = "bilinear") -> DataFrame:
    """Weights of a grid ``factor`` times as fine whose first and last lines lie on those of the coarse one."""
    spark = coarse_cells.sparkSession
    lines = lambda n, name: spark.range(n * factor).select(F.col("id").cast("int").alias(name))
    cells = lines(n_rows, "i").crossJoin(F.broadcast(lines(n_columns, "j")))  # the new grid itself
    place = lambda name, n: F.col(name) * ((n - 1) / (n * factor - 1))
    return at_places(cells, (place("i", n_rows), place("j", n_columns)), n_rows, n_columns, method)


def smoothed(table: DataFrame, cells: DataFrame, n_rows: int, n_columns: int, sigma: float = 1.0) -> DataFrame:
    """The weights of ``table`` followed by a Gaussian pass over its cells, which skips cells without weights; like the
    table itself they don't depend on time, so smoothing costs nothing for each month."""
    import math

    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(v / sum(raw)).alias("g")) for k, v in enumerate(raw)])
    w = table.select("i", "j", "ci", "cj", "w")
    mass = cells.select("i", "j").distinct().join(table.select("i", "j").distinct().withColumn("m", F.lit(1.0)), ["i", "j"], "left").select("i", "j", F.coalesce("m", F.lit(0.0)).alias("m"))
    for index, n in (("i", n_rows), ("j", n_columns)):
        other = "j" if index == "i" else "i"
        to = cells.select("i", "j").distinct().select("i", "j", F.explode(taps).alias("p")).select("i", "j", "p.g", _mirror(F.col(index) + F.col("p.k"), n).alias("_from"))
        moved = w.select(other, F.col(index).alias("_from"), "ci", "cj", "w")
        w = to.join(moved, [other, "_from"]).groupBy("i", "j", "ci", "cj").agg(F.sum(F.col("g") * F.col("w")).alias("w"))
        mass = to.join(mass.select(other, F.col(index).alias("_from"), "m"), [other, "_from"]).groupBy("i", "j").agg(F.sum(F.col("g") * F.col("m")).alias("m"))
    own = table.select("i", "j").distinct()
    return w.join(mass, ["i", "j"]).join(own, ["i", "j"]).select("i", "j", "ci", "cj", (F.col("w") / F.col("m")).alias("w"))


def apply_all(tables: dict[str, DataFrame], coarse: DataFrame, value: str, out: str) -> DataFrame:
    """(method, t, i, j, out) for the weight tables of several methods: one table, one join, one aggregation."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [t.select(F.lit(m).alias("method"), "i", "j", "ci", "cj", "w") for m, t in tables.items()])
    size = every.groupBy("method", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    x = every.join(coarse.select("t", "ci", "cj", value), ["ci", "cj"]).groupBy("method", "t", "i", "j").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.count(value).alias("known"))
    return x.join(size, ["method", "i", "j"]).select("method", "t", "i", "j", F.when(F.col("known") == F.col("n"), F.col("s")).alias(out))


def apply(weights: DataFrame, coarse: DataFrame, value: str, out: str) -> DataFrame:
    """(t, i, j, out): the weighted sum; null where a coarse value that has a weight is missing."""
    size = weights.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    x = weights.join(coarse.select("t", "ci", "cj", value), ["ci", "cj"]).groupBy("t", "i", "j").agg(F.sum(F.col("w") * F.col(value)).alias("s"), F.count(value).alias("known"))
    return x.join(size, ["i", "j"]).select("t", "i", "j", F.when(F.col("known") == F.col("n"), F.col("s")).alias(out))


def _mirror(k: Column, n: int) -> Column:
    """Half-sample reflection: -1 is 0, n is n - 1."""
    return F.when(k < 0, -k - 1).when(k >= n, 2 * n - 1 - k).otherwise(k)


def gaussian(df: DataFrame, value: str, out: str, n_rows: int, n_columns: int, sigma: float = 1.0, restore_nulls: bool = False) -> DataFrame:
    """Smoothing of a complete grid that skips nulls, so nearby gaps are filled; two passes of 2 radius + 1 taps."""
    import math

    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    taps = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(v / sum(raw)).alias("g")) for k, v in enumerate(raw)])
    x = df.select("t", "i", "j", F.coalesce(value, F.lit(0.0)).alias("v"), F.col(value).isNotNull().cast("double").alias("m"))
    for index, n in (("i", n_rows), ("j", n_columns)):
        keys = [c for c in ("t", "i", "j") if c != index]
        to = x.select("t", "i", "j", F.explode(taps).alias("p")).select("t", "i", "j", "p.g", _mirror(F.col(index) + F.col("p.k"), n).alias("_from"))
        x = to.join(x.select(*keys, F.col(index).alias("_from"), "v", "m"), [*keys, "_from"]).groupBy("t", "i", "j").agg(F.sum(F.col("g") * F.col("v")).alias("v"), F.sum(F.col("g") * F.col("m")).alias("m"))
    x = x.select("t", "i", "j", F.when(F.col("m") > 0, F.col("v") / F.col("m")).alias(out))
    if restore_nulls:
        x = x.join(df.select("t", "i", "j", value), ["t", "i", "j"]).withColumn(out, F.when(F.col(value).isNotNull(), F.col(out)))
    return x.select("t", "i", "j", out)


def terrain(df: DataFrame, height: str, n_rows: int, n_columns: int, lat0: float, step: float) -> DataFrame:
    """(i, j, slope, aspect, curvature) of a complete grid: Sobel gradients with reflected edges, in degrees."""
    import math

    dy = step * 111320.0
    dx = step * 111320.0 * math.cos(math.radians(lat0 + step * (n_rows - 1) / 2))

    def gradients(x: DataFrame, v: str, a: str, b: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(float(q * (2 - abs(p)))).alias("wx"), F.lit(float(p * (2 - abs(q)))).alias("wy")) for p in (-1, 0, 1) for q in (-1, 0, 1) if (p, q) != (0, 0)]))
        to = x.select("i", "j", rows.alias("s")).select("i", "j", "s.wx", "s.wy", _mirror(F.col("i") + F.col("s.p"), n_rows).alias("fi"), _mirror(F.col("j") + F.col("s.q"), n_columns).alias("fj"))
        got = to.join(x.select(F.col("i").alias("fi"), F.col("j").alias("fj"), F.col(v).alias("_v")), ["fi", "fj"])
        return got.groupBy("i", "j").agg((F.sum(F.col("wx") * F.col("_v")) / (8 * dx)).alias(a), (F.sum(F.col("wy") * F.col("_v")) / (8 * dy)).alias(b))

    g = gradients(df, height, "gx", "gy")
    second = gradients(g, "gx", "gxx", "_1").join(gradients(g, "gy", "_2", "gyy"), ["i", "j"])
    aspect = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return g.join(second, ["i", "j"]).select(
        "i", "j", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))).alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"), (-(F.col("gxx") + F.col("gyy"))).alias("curvature")
    )
