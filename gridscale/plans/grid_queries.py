"""Queries over sources, alignment, filters and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as op
from ..sources.bind import FACTOR, LAT0, LON0, SIDE, STEP, observed, read, second, signal, sql, static
from .book import Book

book = Book()
BOX = ((28.7, 29.2), (-113.8, -113.2))
POLYGON = [(-113.9, 28.6), (-113.3, 28.55), (-113.05, 29.0), (-113.45, 28.9), (-113.4, 29.45), (-113.85, 29.3)]


def latitude():
    return F.lit(LAT0) + STEP * F.col("i")


def east():
    return F.lit(LON0) + STEP * F.col("j")


def near(x, digits: int = 6):
    """Rounded for comparison; a small shift keeps exact halves from falling either way."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + 1e-7, digits) if digits == 6 else F.round(x, digits)


def r6(name: str, alias: str | None = None):
    return near(F.col(name), 6).alias(alias or name)


@book.add("src01_signal_load", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value FROM signal WHERE t BETWEEN 12 AND 47"))
def signal_load(spark, sf):
    return signal(spark, sf).where(F.col("t").between(12, 47)).select("t", "i", "j", r6("value"))


@book.add("src05_feature_stack", sql("SELECT t, i, j, round(pr + 1e-7, 6) AS pr, round(tmmn + 1e-7, 6) AS tmmn, round(tmmx + 1e-7, 6) AS tmmx, round(aet + 1e-7, 6) AS aet, chirps FROM fine"))
def feature_stack(spark, sf):
    return observed(spark, sf).select("t", "i", "j", r6("pr"), r6("tmmn"), r6("tmmx"), r6("aet"), "chirps")


@book.add("src07_target_grid", sql("SELECT DISTINCT i, j, round(28.525 + 0.05*i + 1e-7, 6) AS lat, round(-113.975 + 0.05*j + 1e-7, 6) AS lon FROM fine"))
def target_grid(spark, sf):
    return observed(spark, sf).select("i", "j").distinct().select("i", "j", near(latitude(), 6).alias("lat"), near(east(), 6).alias("lon"))


@book.add("src08_months_complete", sql("SELECT count(DISTINCT t) AS months, max(t)-min(t)+1 AS expected, count(DISTINCT t) >= 0.95*(max(t)-min(t)+1) AS complete FROM fine"))
def months_complete(spark, sf):
    return observed(spark, sf).agg(F.countDistinct("t").alias("months"), (F.max("t") - F.min("t") + 1).cast("long").alias("expected")).withColumn("complete", F.col("months") >= 0.95 * F.col("expected"))


@book.add("src14_gapped_and_filled", sql("SELECT t, i, j, round(value + 1e-7, 6) AS gapped, round(coalesce(value, avg(value) OVER (PARTITION BY i, j)) + 1e-7, 6) AS filled FROM signal"))
def gapped_and_filled(spark, sf):
    s = signal(spark, sf).select("t", "i", "j", "value")
    means = s.groupBy("i", "j").agg(F.avg("value").alias("m"))
    return s.join(means, ["i", "j"]).select("t", "i", "j", r6("value", "gapped"), near(F.coalesce("value", "m"), 6).alias("filled"))


@book.add("join01_regular_axis", """WITH k AS (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS step, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
a AS (SELECT CAST(unnest(generate_series((SELECT min(step) FROM k), (SELECT max(step) FROM k), INTERVAL 1 DAY)) AS DATE) AS step)
SELECT u.user_id, CAST(a.step AS VARCHAR) AS step, round(k.value + 1e-7, 6) AS value FROM (SELECT DISTINCT user_id FROM k) u CROSS JOIN a LEFT JOIN k USING (user_id, step)""")
def regular(spark, sf):
    return op.regular_axis(read(spark, sf, "events"), ["user_id"], "ts", "value", "day", "event_id").select("user_id", F.col("step").cast("string").alias("step"), r6("value"))


@book.add("prj01_scale_factor", sql("SELECT t, i, j, round(value*(1+n_regionkey/10.0) + 1e-7, 6) AS value FROM fine LEFT JOIN nation ON n_nationkey = i"))
def scale_factor(spark, sf):
    scale = read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (1 + F.col("n_regionkey") / 10.0).alias("scale_factor"))
    return op.scaled(observed(spark, sf).select("t", "i", "j", "value"), scale, ["i"]).select("t", "i", "j", r6("value"))


@book.add("prj02_longitude", sql("""SELECT i, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS j, lon FROM (SELECT i, round(CASE WHEN l > 180 THEN l-360 ELSE l END + 1e-7, 6) AS lon FROM (SELECT i, round(179.525 + 0.05*j + 1e-7, 6) AS l FROM cells))"""))
def longitude(spark, sf):
    x = observed(spark, sf).select("i", near(F.lit(179.525) + STEP * F.col("j"), 6).alias("l"), "j").distinct()
    x = x.withColumn("lon", near(op.signed_longitude(F.col("l")), 6))
    return op.reindex(x, "lon", "j").select("i", F.col("j").cast("int").alias("j"), "lon")


@book.add("prj03_unit_factors", sql("SELECT t, i, j, round(aet*30.44*24*3600, 2) AS aet, round(tmmn/10 + 1e-7, 6) AS tmmn, round(tmmx/10 + 1e-7, 6) AS tmmx, round(pr + 1e-7, 6) AS pr FROM fine"))
def unit_factors(spark, sf):
    factors = {"aet": 30.44 * 24 * 3600, "tmmn": 0.1, "tmmx": 0.1, "pr": 1.0}
    return observed(spark, sf).select("t", "i", "j", *[near(F.col(c) / 10 if f == 0.1 else F.col(c) * f, 2 if c == "aet" else 4).alias(c) for c, f in factors.items()])


@book.add("prj04_mean_temperature", sql("SELECT t, i, j, round((tmmn+tmmx)/2 + 1e-7, 6) AS tmean, round(pr + 1e-7, 6) AS pr FROM fine"))
def mean_temperature(spark, sf):
    return observed(spark, sf).withColumn("tmean", (F.col("tmmn") + F.col("tmmx")) / 2).drop("tmmn", "tmmx").select("t", "i", "j", r6("tmean"), r6("pr"))


@book.add("prj05_one_hot", sql("SELECT i, j, " + ", ".join(f"CASE WHEN land_cover = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lc_{k}" for k in range(1, 18)) + " FROM static"))
def one_hot(spark, sf):
    return op.one_hot(static(spark, sf), "land_cover", range(1, 18), "lc_").select("i", "j", *[f"lc_{k}" for k in range(1, 18)])


@book.add("prj06_feature_matrix", sql("SELECT t, i, j, round(pr + 1e-7, 6) AS pr, round(tmmx + 1e-7, 6) AS tmmx, round(population + 1e-7, 6) AS population, round(elevation + 1e-7, 6) AS elevation FROM fine LEFT JOIN static USING (i, j)"))
def feature_matrix(spark, sf):
    return observed(spark, sf).join(static(spark, sf), ["i", "j"], "left").select("t", "i", "j", r6("pr"), r6("tmmx"), r6("population"), r6("elevation"))


@book.add("flt02_clip_box", sql(f"SELECT t, i, j, round(value + 1e-7, 6) AS value FROM fine WHERE 28.525+0.05*i BETWEEN {BOX[0][0]} AND {BOX[0][1]} AND -113.975+0.05*j BETWEEN {BOX[1][0]} AND {BOX[1][1]}"))
def clip_box(spark, sf):
    return op.clip_box(observed(spark, sf).withColumn("lat", latitude()).withColumn("lon", east()), *BOX).select("t", "i", "j", r6("value"))


@book.add("flt03_bounds", sql("SELECT round(min(28.525+0.05*i) + 1e-7, 6) AS lat_min, round(max(28.525+0.05*i) + 1e-7, 6) AS lat_max, count(DISTINCT i) AS n_lat, count(DISTINCT j) AS n_lon, abs(count(DISTINCT i)-20) <= 2 AS shape_ok FROM fine"))
def bounds(spark, sf):
    return observed(spark, sf).withColumn("lat", latitude()).agg(near(F.min("lat"), 6).alias("lat_min"), near(F.max("lat"), 6).alias("lat_max"), F.countDistinct("i").alias("n_lat"), F.countDistinct("j").alias("n_lon")).withColumn("shape_ok", F.abs(F.col("n_lat") - 20) <= 2)


@book.add("flt04_complete_cases", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value, round(other + 1e-7, 6) AS other FROM signal LEFT JOIN second USING (t, i, j) WHERE value IS NOT NULL AND pr IS NOT NULL AND other IS NOT NULL"))
def complete_cases(spark, sf):
    return signal(spark, sf).join(second(spark, sf), ["t", "i", "j"], "left").dropna(subset=["value", "pr", "other"]).select("t", "i", "j", r6("value"), r6("other"))


@book.add("flt05_coverage_mask", sql("SELECT t, i, j, CASE WHEN m.i0 IS NOT NULL THEN round(pr + 1e-7, 6) END AS pr FROM signal LEFT JOIN (SELECT i AS i0, j AS j0 FROM signal WHERE t = (SELECT min(t) FROM fine) AND value IS NOT NULL) m ON i = i0 AND j = j0"))
def coverage_mask(spark, sf):
    s = signal(spark, sf)
    first = s.agg(F.min("t").alias("t"))
    mask = s.join(F.broadcast(first), "t").where("value is not null").select("i", "j", F.lit(True).alias("covered"))
    return s.join(mask, ["i", "j"], "left").select("t", "i", "j", F.when(F.col("covered"), near("pr", 6)).alias("pr"))


def _polygon_sql() -> str:
    crossing, on = [], []
    for x1, y1, x2, y2 in op.edges_of(POLYGON):
        crossing.append(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < {x1} + (lat-({y1}))*(({x2}-({x1}))/({y2}-({y1}))) THEN 1 ELSE 0 END)")
        on.append(f"(abs((lon-({x1}))*({y2}-({y1}))-(lat-({y1}))*({x2}-({x1}))) < 1e-12 AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
    return f"SELECT i, j, ({' OR '.join(on)}) OR ({' + '.join(crossing)}) % 2 = 1 AS inside FROM (SELECT i, j, 28.525::DOUBLE+0.05::DOUBLE*i AS lat, -113.975::DOUBLE+0.05::DOUBLE*j AS lon FROM cells)"


@book.add("flt06_polygon_mask", sql(_polygon_sql()))
def polygon_mask(spark, sf):
    cells = observed(spark, sf).select("i", "j").distinct().withColumn("lat", latitude()).withColumn("lon", east())
    return op.in_polygon(cells, op.edges_of(POLYGON)).select("i", "j", "inside")


@book.add("flt08_outliers_iqr", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value FROM fine JOIN (SELECT i, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM fine GROUP BY i) q USING (i) WHERE value BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)"))
def outliers_iqr(spark, sf):
    return op.without_outliers(observed(spark, sf), "value", "i").select("t", "i", "j", r6("value"))


@book.add("flt08_outliers_zscore", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value FROM fine JOIN (SELECT i, avg(value) AS m, stddev_samp(value) AS s FROM fine GROUP BY i) q USING (i) WHERE abs(value-m) < 2*s"))
def outliers_zscore(spark, sf):
    return op.without_outliers(observed(spark, sf), "value", "i", "zscore", 2.0).select("t", "i", "j", r6("value"))


@book.add("flt09_clip_spread", sql("SELECT t, i, j, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, m+2*s), m-2*s) END + 1e-7, 6) AS value FROM signal, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM signal)"))
def clip_spread(spark, sf):
    return op.clip_spread(signal(spark, sf).select("t", "i", "j", "value"), "value", 2.0).select("t", "i", "j", r6("value"))


@book.add("flt10_hash_sample", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value FROM fine ORDER BY md5(concat_ws('-', t, i, j, '42')) LIMIT 500"))
def hash_sample(spark, sf):
    return op.hash_sample(observed(spark, sf), ["t", "i", "j"], 500, "42").select("t", "i", "j", r6("value"))


@book.add("flt11_scale_check", "SELECT count(*) AS n, count(*) FILTER (WHERE 1+n_regionkey/10.0 <= 0) AS non_positive, count(*) FILTER (WHERE 1+n_regionkey/10.0 > 10) AS above_10 FROM nation")
def scale_check(spark, sf):
    s = read(spark, sf, "nation").select((1 + F.col("n_regionkey") / 10.0).alias("s"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") <= 0).alias("non_positive"), F.count_if(F.col("s") > 10).alias("above_10"))


_LINES = "known AS (SELECT n_nationkey AS i, round(1+n_regionkey/10.0 + 1e-7, 6) AS f FROM nation)"


@book.add("join02_scale_alignment", sql("SELECT i, j, coalesce(s.f, near, 1.0) AS scale_factor FROM cells LEFT JOIN known s USING (i) LEFT JOIN (SELECT c.i, first(k.f ORDER BY k.f IS NULL, abs(c.i-k.i), k.i) AS near FROM (SELECT DISTINCT i FROM cells) c CROSS JOIN known k GROUP BY c.i) USING (i)", _LINES))
def scale_alignment(spark, sf):
    """Factors of the lines that have one; lines that have none take the nearest line's, else 1."""
    known = read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), near(1 + F.col("n_regionkey") / 10.0, 6).alias("f"))
    exact = observed(spark, sf).select("i", "j").distinct().join(known, "i", "left")
    line = lambda x: x.select("i", F.lit(0).alias("j"), "f")
    nearest = op.nearest_known(line(exact.where("f is null")), line(known.where("f is not null")), "f").select("i", F.col("f").alias("near"))
    return exact.join(nearest, "i", "left").select("i", "j", F.coalesce("f", "near", F.lit(1.0)).alias("scale_factor"))


_SCALE = "known AS (SELECT CAST(s_suppkey % 20 AS INT) AS i, CAST((s_suppkey // 20) % 20 AS INT) AS j, CAST(1 + avg(s_nationkey)/100.0 AS DOUBLE) AS f FROM supplier GROUP BY 1, 2)"


@book.add("join02_supplier_alignment", sql("SELECT i, j, round(coalesce(f, near, 1.0) + 1e-7, 6) AS scale_factor FROM cells LEFT JOIN known USING (i, j) LEFT JOIN (SELECT c.i, c.j, first(k.f ORDER BY (c.i-k.i)*(c.i-k.i)+(c.j-k.j)*(c.j-k.j), k.i, k.j) AS near FROM cells c CROSS JOIN known k GROUP BY c.i, c.j) USING (i, j)", _SCALE))
def supplier_alignment(spark, sf):
    """Scale factors of the cells that have suppliers; cells that have none take the nearest cell's, else 1."""
    place = [(F.col("s_suppkey") % SIDE).cast("int").alias("i"), (F.floor(F.col("s_suppkey") / SIDE) % SIDE).cast("int").alias("j")]
    known = read(spark, sf, "supplier").groupBy(*place).agg((1 + F.avg("s_nationkey") / 100.0).alias("f"))
    exact = observed(spark, sf).select("i", "j").distinct().join(known, ["i", "j"], "left")
    nearest = op.nearest_known(exact.where("f is null"), known, "f").withColumnRenamed("f", "near")
    return exact.join(nearest, ["i", "j"], "left").select("i", "j", near(F.coalesce("f", "near", F.lit(1.0)), 6).alias("scale_factor"))


@book.add("join03_residual", sql("SELECT t, i, j, round(value-other + 1e-7, 6) AS residual FROM fine JOIN second USING (t, i, j)"))
def residual(spark, sf):
    return observed(spark, sf).join(second(spark, sf), ["t", "i", "j"]).select("t", "i", "j", near(F.col("value") - F.col("other"), 6).alias("residual"))


@book.add("join05_three_way", sql("SELECT t, ci, cj, round(a + 1e-7, 6) AS a, round(b + 1e-7, 6) AS b, round(c + 1e-7, 6) AS c FROM (SELECT t, i//5 AS ci, j//5 AS cj, avg(value) AS a FROM fine GROUP BY 1,2,3) JOIN (SELECT t, i//5 AS ci, j//5 AS cj, avg(other) AS b FROM second GROUP BY 1,2,3) USING (t, ci, cj) JOIN (SELECT t, i//5 AS ci, j//5 AS cj, sum(pr) AS c FROM fine GROUP BY 1,2,3) USING (t, ci, cj)"))
def three_way(spark, sf):
    def block(df, agg):
        return df.groupBy("t", F.floor(F.col("i") / FACTOR).cast("int").alias("ci"), F.floor(F.col("j") / FACTOR).cast("int").alias("cj")).agg(agg)

    a, b, c = block(observed(spark, sf), F.avg("value").alias("a")), block(second(spark, sf), F.avg("other").alias("b")), block(observed(spark, sf), F.sum("pr").alias("c"))
    return a.join(b, ["t", "ci", "cj"]).join(c, ["t", "ci", "cj"]).select("t", "ci", "cj", r6("a"), r6("b"), r6("c"))


@book.add("join16_missing_months", sql("SELECT i, j, t FROM cells CROSS JOIN months ANTI JOIN fine USING (t, i, j)"))
def missing_months(spark, sf):
    s = signal(spark, sf).select("t", "i", "j")
    return s.join(observed(spark, sf).select("t", "i", "j"), ["t", "i", "j"], "left_anti").select("i", "j", "t")


@book.add("join17_recreate_gaps", sql("SELECT t, i, j, CASE WHEN x.t IS NULL THEN round(filled + 1e-7, 6) END AS value FROM (SELECT t, i, j, coalesce(value, 0) AS filled FROM signal) LEFT JOIN (SELECT t, i, j FROM signal WHERE value IS NULL) x USING (t, i, j)"))
def recreate_gaps(spark, sf):
    s = signal(spark, sf)
    gaps = s.where("value is null").select("t", "i", "j", F.lit(True).alias("gap"))
    return s.withColumn("filled", F.coalesce("value", F.lit(0.0))).join(gaps, ["t", "i", "j"], "left").select("t", "i", "j", F.when(F.col("gap").isNull(), near("filled", 6)).alias("value"))


@book.add("set01_common_months", sql("SELECT t FROM (SELECT t FROM fine INTERSECT SELECT t FROM second)"))
def common_months(spark, sf):
    return observed(spark, sf).select("t").intersect(second(spark, sf).select("t"))


@book.add("set02_only_first", sql("SELECT t FROM (SELECT t FROM fine EXCEPT SELECT t FROM second)"))
def only_first(spark, sf):
    return observed(spark, sf).select("t").subtract(second(spark, sf).select("t"))


@book.add("set03_all_months", sql("SELECT t FROM (SELECT t FROM fine UNION SELECT t FROM second)"))
def all_months(spark, sf):
    return observed(spark, sf).select("t").union(second(spark, sf).select("t")).distinct()
