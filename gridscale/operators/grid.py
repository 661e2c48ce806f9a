"""Alignment, filters and masks on grid tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regular_axis(raw: DataFrame, cell: list[str], ts: str, value: str, unit: str, tie: str | None = None) -> DataFrame:
    """Irregular timestamps on a regular axis of ``unit`` steps: the last value of a step wins, absent steps are null."""
    step = F.date_trunc(unit, F.col(ts)).cast("date")
    latest = F.struct(ts, tie) if tie else F.col(ts)
    known = raw.groupBy(*cell, step.alias("step")).agg(F.max_by(value, latest).alias(value))
    ends = known.agg(F.min("step").alias("a"), F.max("step").alias("b"))
    axis = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("step"))
    return known.select(*cell).distinct().crossJoin(F.broadcast(axis)).join(known, [*cell, "step"], "left")


def signed_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def reindex(df: DataFrame, coordinate: str, index: str) -> DataFrame:
    """``index`` becomes the rank of ``coordinate`` among its distinct values, from 0."""
    axis = df.select(coordinate).distinct()  # one row for each line of the grid
    ranked = axis.withColumn(index, F.row_number().over(Window.orderBy(coordinate)) - 1)
    return df.drop(index).join(F.broadcast(ranked), coordinate)


def clip_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return df.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def scaled(df: DataFrame, scale: DataFrame, keys: list[str], value: str = "value", factor: str = "scale_factor") -> DataFrame:
    """``value`` times the factor of its cell; cells without a factor keep their value."""
    return df.join(scale, keys, "left").withColumn(value, F.col(value) * F.coalesce(factor, F.lit(1.0))).drop(factor)


def one_hot(df: DataFrame, column: str, classes: range, prefix: str) -> DataFrame:
    return df.select("*", *[F.coalesce((F.col(column) == k).cast("double"), F.lit(0.0)).alias(f"{prefix}{k}") for k in classes])


def in_polygon(points: DataFrame, edges: list[tuple[float, float, float, float]], x: str = "lon", y: str = "lat") -> DataFrame:
    """``inside`` for each point: parity of crossings with the edges (x1, y1, x2, y2); points on an edge are inside."""
    px, py = F.col(x), F.col(y)
    crossings, on = F.lit(0), F.lit(False)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            at = F.lit(x1) + (py - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < at), 1).otherwise(0)
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        on = on | ((F.abs(cross) < 1e-12) & px.between(min(x1, x2), max(x1, x2)) & py.between(min(y1, y2), max(y1, y2)))
    return points.withColumn("inside", on | (crossings % 2 == 1))


def edges_of(vertices: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(vertices, [*vertices[1:], vertices[0]], strict=True)]


def without_outliers(df: DataFrame, value: str, group: str, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Rows within the quartile fences of their group, or within ``factor`` sample deviations of its mean."""
    if method == "iqr":
        s = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        s = s.select(group, (F.col("q")[0] - factor * (F.col("q")[1] - F.col("q")[0])).alias("lo"), (F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0])).alias("hi"))
        return df.join(s, group).where(F.col(value).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    s = df.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return df.join(s, group).where(F.abs(F.col(value) - F.col("m")) < factor * F.col("s")).drop("m", "s")


def clip_spread(df: DataFrame, value: str, n_std: float = 3.0) -> DataFrame:
    """``value`` held within ``n_std`` population deviations of the mean of all rows; null stays null."""
    s = df.agg((F.avg(value) - n_std * F.stddev_pop(value)).alias("lo"), (F.avg(value) + n_std * F.stddev_pop(value)).alias("hi"))
    return df.crossJoin(F.broadcast(s)).withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.least(value, "hi"), "lo"))).drop("lo", "hi")


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, the same for the same keys and seed."""
    return df.orderBy(F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(seed)))).limit(n)


def in_any_polygon(points: DataFrame, polygons: list[list[tuple[float, float]]], x: str = "lon", y: str = "lat") -> DataFrame:
    """``inside`` for each point: whether one of the polygons holds it."""
    flags = []
    for k, ring in enumerate(polygons):
        points = in_polygon(points, edges_of(ring), x, y).withColumnRenamed("inside", f"_in{k}")
        flags.append(F.col(f"_in{k}"))
    return points.withColumn("inside", F.greatest(*flags, F.lit(False))).drop(*[f"_in{k}" for k in range(len(polygons))])


def aggregation_factor(coarse_step: float, fine_step: float) -> int:
    """Fine cells along a side of a coarse one."""
    return round(coarse_step / fine_step)


def matched(columns: list[str], wanted: list[str], prefix: str = "soil_") -> dict[str, str]:
    """Column for each wanted name, in the order wanted: the name itself, or without ``prefix``; names found nowhere are left out."""
    out = {}
    for name in wanted:
        bare = name.removeprefix(prefix)
        if name in columns or bare in columns:
            out[name] = name if name in columns else bare
    return out


def base_subset(df: DataFrame, names: list[str], keys: list[str], n: int = 10) -> DataFrame:
    """Keys and the first ``n`` training features; an error tells which are absent."""
    absent = [c for c in names[:n] if c not in df.columns]
    if absent:
        raise ValueError(f"base features not found: {absent}")
    return df.select(*keys, *names[:n])


def axes(df: DataFrame | None, spark, n_rows: int, n_columns: int, n_months: int, box: tuple[float, float, float, float]) -> DataFrame:
    """(t, i, j, lat, lon): distinct cells and months of ``df``, or evenly spaced ones over ``box`` where there is none."""
    if df is not None:
        return df.select("i", "j", "lat", "lon").distinct().crossJoin(F.broadcast(df.select("t").distinct()))  # the month axis
    line = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    grid = line(n_rows, "i").crossJoin(F.broadcast(line(n_columns, "j"))).crossJoin(F.broadcast(line(n_months, "t")))
    at = lambda k, n, lo, hi: F.lit(lo) + F.col(k) * ((hi - lo) / max(n - 1, 1))
    return grid.select("t", "i", "j", at("i", n_rows, box[0], box[1]).alias("lat"), at("j", n_columns, box[2], box[3]).alias("lon"))


def nearest_known(cells: DataFrame, known: DataFrame, value: str, reach: int = 4) -> DataFrame:
    """(i, j, value): for each distinct cell (i, j) the value of the nearest row of ``known`` (i, j, value); of equally near
    ones that of the smallest i, then j. Null where ``known`` is empty.

    Cells and known rows meet in square buckets of ``reach`` lines. A ring of buckets around a cell settles it if it holds
    a row no farther than the ring is wide; only cells that are not settled go on to a ring twice as wide, so work follows
    the distance to what is known and no cell meets all rows.
    """
    from ..sources.scratch import Written

    bucket = lambda c: F.floor(F.col(c) / reach)
    k = Written(known.select(F.col("i").alias("ki"), F.col("j").alias("kj"), F.col(value).alias("kv")).withColumn("bi", bucket("ki")).withColumn("bj", bucket("kj"))).table
    ends = k.agg(F.min("ki"), F.max("ki"), F.min("kj"), F.max("kj")).first()
    rest = Written(cells.select("i", "j").distinct()).table
    if ends[0] is None:
        return rest.withColumn(value, F.lit(None).cast(known.schema[value].dataType))
    own = rest.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    if own[0] is None:
        return rest.withColumn(value, F.lit(None).cast(known.schema[value].dataType))
    span = max(abs(a - b) for a, b in ((own[0], ends[1]), (own[1], ends[0]), (own[2], ends[3]), (own[3], ends[2])))
    settled, ring = None, 1
    while True:
        steps = F.sequence(F.lit(-ring), F.lit(ring))
        # the rows of a bucket lie within the known extent, so a ring's empty outside is left out before it is met
        low, high = [F.lit(int(v) // reach) for v in (ends[0], ends[2])], [F.lit(int(v) // reach) for v in (ends[1], ends[3])]
        near = rest.withColumn("bi", F.explode(F.filter(F.transform(steps, lambda x: bucket("i") + x), lambda x: (x >= low[0]) & (x <= high[0]))))
        near = near.withColumn("bj", F.explode(F.filter(F.transform(steps, lambda x: bucket("j") + x), lambda x: (x >= low[1]) & (x <= high[1]))))
        apart = F.pow(F.col("i") - F.col("ki"), 2) + F.pow(F.col("j") - F.col("kj"), 2)
        best = near.join(k, ["bi", "bj"]).groupBy("i", "j").agg(F.min(F.struct(apart.alias("d"), "ki", "kj", "kv")).alias("b"))
        whole = ring * reach >= span
        found = Written(best.where(F.lit(whole) | (F.col("b.d") <= float(ring * reach) ** 2)).select("i", "j", F.col("b.kv").alias(value))).table
        settled = found if settled is None else settled.unionByName(found)
        if whole:
            return settled
        rest = Written(rest.join(found, ["i", "j"], "left_anti")).table
        if rest.isEmpty():
            return settled
        ring *= 2
