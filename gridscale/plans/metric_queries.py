"""Queries over metrics, audits, trials and cross-validation tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.metrics import regression, summary
from ..operators.ordered import numbered
from ..operators.series import linear_fill
from ..sources.bind import observed, read, second, signal, sql
from .book import Book
from .grid_queries import r6
from .series_queries import _LINE

book = Book()


def paired(spark, sf):
    return observed(spark, sf).join(second(spark, sf), ["t", "i", "j"])


PAIRED = "p AS (SELECT t, i, j, value, other FROM fine JOIN second USING (t, i, j))"


def rounded(df, digits: int = 4, keep: tuple = ()):
    """All floating columns but ``keep`` rounded to ``digits``, after a shift that settles exact halves."""
    shift = 1.3 * 10.0 ** -(digits + 1)
    return df.select(*[F.round(F.col(f"`{n}`") + shift, digits).alias(n) if t == "double" and n not in keep else F.col(f"`{n}`") for n, t in df.dtypes])


def rounded_sql(body: str, floats: str, plain: str = "", digits: int = 4) -> str:
    shift = f"1.3e-{digits + 1}"
    columns = [f"round(CAST({c} AS DOUBLE) + {shift}, {digits}) AS {c}" for c in floats.split()] + plain.split()
    return f"SELECT {', '.join(columns)} FROM ({body})"


_SUMMARY = "avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, count(value) AS n_valid, count(*) AS n_total, 100.0*count(value)/count(*) AS pct_valid"
_FLOATS = "mean std min max median q25 q75 pct_valid"


@book.add("agg08_summary", sql(rounded_sql(f"SELECT {_SUMMARY} FROM signal", _FLOATS, "n_valid n_total")))
def summary_all(spark, sf):
    return rounded(summary(signal(spark, sf), "value", []))


@book.add("agg09_product_statistics", sql(rounded_sql("SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(other) AS m2, stddev_pop(other) AS s2, avg(abs(value-other)) AS mean_abs_correction, 100.0*count(other)/count(*) AS coverage FROM fine LEFT JOIN second USING (t, i, j)", "m1 s1 m2 s2 mean_abs_correction coverage")))
def product_statistics(spark, sf):
    x = observed(spark, sf).join(second(spark, sf), ["t", "i", "j"], "left")
    return rounded(x.agg(F.avg("value").alias("m1"), F.stddev_pop("value").alias("s1"), F.avg("other").alias("m2"), F.stddev_pop("other").alias("s2"), F.avg(F.abs(F.col("value") - F.col("other"))).alias("mean_abs_correction"), (100.0 * F.count("other") / F.count(F.lit(1))).alias("coverage")))


@book.add("agg10_spatial_metrics", sql(rounded_sql("SELECT avg(m) AS mean_of_means, stddev_pop(m) AS std_of_means, max(m)-min(m) AS range_of_means, avg(s) AS mean_of_std FROM (SELECT i, j, avg(value) AS m, stddev_pop(value) AS s FROM fine GROUP BY i, j)", "mean_of_means std_of_means range_of_means mean_of_std")))
def spatial_metrics(spark, sf):
    c = observed(spark, sf).groupBy("i", "j").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rounded(c.agg(F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("std_of_means"), (F.max("m") - F.min("m")).alias("range_of_means"), F.avg("s").alias("mean_of_std")))


@book.add("agg11_temporal_metrics", sql(rounded_sql("SELECT avg(m) AS mean_of_months, avg(s) AS mean_of_spread FROM (SELECT t, avg(value) AS m, stddev_pop(value) AS s FROM fine GROUP BY t)", "mean_of_months mean_of_spread")))
def temporal_metrics(spark, sf):
    c = observed(spark, sf).groupBy("t").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rounded(c.agg(F.avg("m").alias("mean_of_months"), F.avg("s").alias("mean_of_spread")))


@book.add("agg12_trend", sql(rounded_sql("SELECT regr_slope(m, t) AS slope FROM (SELECT t, avg(value) AS m FROM fine GROUP BY t)", "slope")))
def trend(spark, sf):
    return rounded(observed(spark, sf).groupBy("t").agg(F.avg("value").alias("m")).agg(F.regr_slope("m", "t").alias("slope")))


@book.add("agg13_seasonal_cycle", sql(rounded_sql("SELECT t % 12 + 1 AS month, avg(m) AS mean, stddev_pop(m) AS std FROM (SELECT t, avg(value) AS m FROM fine GROUP BY t) GROUP BY 1", "mean std", "month")))
def seasonal_cycle(spark, sf):
    m = observed(spark, sf).groupBy("t").agg(F.avg("value").alias("m"))
    return rounded(m.groupBy((F.col("t") % 12 + 1).alias("month")).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")))


_REGRESSION = "count(*) AS n, 1-sum((other-value)**2)/(var_pop(value)*count(*)) AS r2, sqrt(avg((other-value)**2)) AS rmse, avg(abs(other-value)) AS mae, avg(other-value) AS bias, corr(value, other) AS r, regr_slope(other, value) AS slope, regr_intercept(other, value) AS intercept"


@book.add("agg14_comparison", sql(rounded_sql(f"SELECT {_REGRESSION} FROM p", "r2 rmse mae bias r slope intercept", "n"), PAIRED))
def comparison(spark, sf):
    return rounded(regression(paired(spark, sf), "value", "other", []))


@book.add("agg15_comparison_by_row", sql(rounded_sql(f"SELECT i, {_REGRESSION} FROM p GROUP BY i", "r2 rmse mae bias r slope intercept", "n i"), PAIRED))
def comparison_by_row(spark, sf):
    return rounded(regression(paired(spark, sf), "value", "other", ["i"]))


@book.add("agg16_month_statistics", sql(rounded_sql("SELECT t, avg(value) AS mean_raw, count(value) AS n_valid, count(*)-count(value) AS n_missing, avg(filled) AS mean, stddev_pop(filled) AS std, quantile_cont(filled, 0.5) AS median, quantile_cont(filled, 0.25) AS q25, quantile_cont(filled, 0.75) AS q75 FROM line GROUP BY t", "mean_raw mean std median q25 q75", "t n_valid n_missing"), _LINE))
def month_statistics(spark, sf):
    x = linear_fill(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled")
    q = F.percentile("filled", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = x.groupBy("t").agg(F.avg("value").alias("mean_raw"), F.count("value").alias("n_valid"), (F.count(F.lit(1)) - F.count("value")).alias("n_missing"), F.avg("filled").alias("mean"), F.stddev_pop("filled").alias("std"), q.alias("q"))
    return rounded(g.select("t", "mean_raw", "n_valid", "n_missing", "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75")))


@book.add("agg17_gap_summary", sql(rounded_sql("SELECT count(*)-count(value) AS missing, 100.0*count(filled)/count(*) AS success_pct, avg(abs(filled)) AS mean_abs, max(filled)-min(filled) AS spread, corr(filled, before) AS lag1 FROM (SELECT *, lag(filled) OVER (PARTITION BY i, j ORDER BY t) AS before FROM line)", "success_pct mean_abs spread lag1", "missing"), _LINE))
def gap_summary(spark, sf):
    x = linear_fill(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled").withColumn("before", F.lag("filled").over(Window.partitionBy("i", "j").orderBy("t")))
    return rounded(x.agg((F.count(F.lit(1)) - F.count("value")).alias("missing"), (100.0 * F.count("filled") / F.count(F.lit(1))).alias("success_pct"), F.avg(F.abs("filled")).alias("mean_abs"), (F.max("filled") - F.min("filled")).alias("spread"), F.corr("filled", "before").alias("lag1")))


@book.add("agg18_fill_accuracy", sql(rounded_sql("SELECT corr(a, b) AS month_correlation, avg(abs(a-b)) AS mean_gap, sum(n) AS n FROM (SELECT t, avg(value) AS a, avg(filled) AS b, count(value) AS n FROM line GROUP BY t)", "month_correlation mean_gap n"), _LINE))
def fill_accuracy(spark, sf):
    m = linear_fill(signal(spark, sf).select("t", "i", "j", "value"), "value", "filled").groupBy("t").agg(F.avg("value").alias("a"), F.avg("filled").alias("b"), F.count("value").alias("n"))
    return rounded(m.agg(F.corr("a", "b").alias("month_correlation"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_gap"), F.sum("n").cast("double").alias("n")))


@book.add("agg20_scale_report", sql(rounded_sql("SELECT min(r) AS min_ratio, max(r) AS max_ratio, avg(r) AS mean_ratio, stddev_pop(r) AS std_ratio, avg(value) AS mean_before, avg(value*f) AS mean_after, avg(value*f)/avg(value) AS correction, 100.0*count(*) FILTER (WHERE f <> 1)/count(*) AS pct_corrected FROM (SELECT value, 1+n_regionkey/10.0::DOUBLE AS f, value*(1+n_regionkey/10.0::DOUBLE)/value AS r FROM fine JOIN nation ON n_nationkey = i)", "min_ratio max_ratio mean_ratio std_ratio mean_before mean_after correction pct_corrected")))
def scale_report(spark, sf):
    x = observed(spark, sf).join(read(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (1 + F.col("n_regionkey") / 10.0).alias("f")), "i").withColumn("r", F.col("value") * F.col("f") / F.col("value"))
    after = F.avg(F.col("value") * F.col("f"))
    return rounded(x.agg(F.min("r").alias("min_ratio"), F.max("r").alias("max_ratio"), F.avg("r").alias("mean_ratio"), F.stddev_pop("r").alias("std_ratio"), F.avg("value").alias("mean_before"), after.alias("mean_after"), (after / F.avg("value")).alias("correction"), (100.0 * F.count_if(F.col("f") != 1) / F.count(F.lit(1))).alias("pct_corrected")))


# cross-validation results: a model is an order priority, a fold a block of rows and months
CV = "cv AS (SELECT i // 10 AS sb, t // 28 AS tb, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS model, 1-sum((other-value)**2)/(var_pop(value)*count(*)) AS r2, sqrt(avg((other-value)**2)) AS rmse, avg(abs(other-value)) AS mae, count(*) AS n FROM p GROUP BY 1, 2, 3)"


def cv_results(spark, sf):
    x = paired(spark, sf).withColumns({"sb": F.floor(F.col("i") / 10).cast("int"), "tb": F.floor(F.col("t") / 28).cast("int"), "model": F.when(F.col("i") % 2 == 0, "even").otherwise("odd")})
    return regression(x, "value", "other", ["sb", "tb", "model"]).select("sb", "tb", "model", "r2", "rmse", "mae", "n")


@book.add("agg21_cv_summary", sql(rounded_sql("SELECT model, avg(r2) AS mean_r2, stddev_samp(r2) AS std_r2, avg(rmse) AS mean_rmse, stddev_samp(rmse) AS std_rmse, avg(mae) AS mean_mae, count(*) AS n_folds FROM cv GROUP BY model", "mean_r2 std_r2 mean_rmse std_rmse mean_mae", "model n_folds"), PAIRED, CV))
def cv_summary(spark, sf):
    return rounded(cv_results(spark, sf).groupBy("model").agg(F.avg("r2").alias("mean_r2"), F.stddev_samp("r2").alias("std_r2"), F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("std_rmse"), F.avg("mae").alias("mean_mae"), F.count(F.lit(1)).alias("n_folds")))


@book.add("agg22_block_matrix", sql(rounded_sql("SELECT sb, max(CASE WHEN tb=0 THEN r2 END) AS t0, max(CASE WHEN tb=1 THEN r2 END) AS t1, max(CASE WHEN tb=2 THEN r2 END) AS t2 FROM cv WHERE model = 'even' GROUP BY sb", "t0 t1 t2", "sb"), PAIRED, CV))
def block_matrix(spark, sf):
    x = cv_results(spark, sf).where("model = 'even'").groupBy("sb").pivot("tb", [0, 1, 2]).agg(F.first("r2"))
    return rounded(x.toDF("sb", "t0", "t1", "t2"))


@book.add("agg22_block_classes", sql("SELECT sb, CASE WHEN avg(r2) >= 0.5 THEN 'good' WHEN avg(r2) >= 0 THEN 'fair' ELSE 'poor' END AS class FROM cv GROUP BY sb", PAIRED, CV))
def block_classes(spark, sf):
    m = cv_results(spark, sf).groupBy("sb").agg(F.avg("r2").alias("m"))
    return m.select("sb", F.when(F.col("m") >= 0.5, "good").when(F.col("m") >= 0, "fair").otherwise("poor").alias("class"))


@book.add("agg23_method_comparison", sql(rounded_sql("SELECT model, avg(rmse) AS mean, stddev_samp(rmse) AS std, var_samp(rmse) AS variance, max(rmse)-min(rmse) AS spread, stddev_samp(rmse)/avg(rmse) AS cv, count(*) AS folds FROM cv GROUP BY model", "mean std variance spread cv", "model folds"), PAIRED, CV))
def method_comparison(spark, sf):
    return rounded(cv_results(spark, sf).groupBy("model").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"), F.var_samp("rmse").alias("variance"), (F.max("rmse") - F.min("rmse")).alias("spread"), (F.stddev_samp("rmse") / F.avg("rmse")).alias("cv"), F.count(F.lit(1)).alias("folds")))


@book.add("join07_fold_metadata", sql(rounded_sql("SELECT sb, tb, model, rmse, sb*3+tb+1 AS fold, lo, hi FROM cv LEFT JOIN (SELECT t // 28 AS tb, min(t) AS lo, max(t) AS hi FROM fine GROUP BY 1) USING (tb)", "rmse", "sb tb model fold lo hi"), PAIRED, CV))
def fold_metadata(spark, sf):
    meta = observed(spark, sf).groupBy(F.floor(F.col("t") / 28).cast("int").alias("tb")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    x = cv_results(spark, sf).join(meta, "tb", "left")
    return rounded(x.select("sb", "tb", "model", "rmse", (F.col("sb") * 3 + F.col("tb") + 1).alias("fold"), "lo", "hi"))


@book.add("srt03_best_model", sql("SELECT arg_max(model, m) AS best FROM (SELECT model, avg(r2) AS m FROM cv GROUP BY model)", PAIRED, CV))
def best_model(spark, sf):
    return cv_results(spark, sf).groupBy("model").agg(F.avg("r2").alias("m")).agg(F.max_by("model", "m").alias("best"))


@book.add("srt05_best_worst_block", sql("SELECT arg_max(sb, r) AS best, arg_min(sb, r) AS worst FROM (SELECT sb, avg(rmse) AS r FROM cv GROUP BY sb)", PAIRED, CV))
def best_worst_block(spark, sf):
    return cv_results(spark, sf).groupBy("sb").agg(F.avg("rmse").alias("r")).agg(F.max_by("sb", "r").alias("best"), F.min_by("sb", "r").alias("worst"))


@book.add("set04_common_models", sql("SELECT model FROM (SELECT model FROM cv WHERE r2 < 1 INTERSECT SELECT model FROM cv WHERE tb = 0)", PAIRED, CV))
def common_models(spark, sf):
    x = cv_results(spark, sf)
    return x.where("r2 < 1").select("model").intersect(x.where("tb = 0").select("model"))


@book.add("ml13_ensemble_weights", sql(rounded_sql("SELECT model, greatest(w, 0.05)/sum(greatest(w, 0.05)) OVER () AS weight FROM (SELECT model, (1/m)/sum(1/m) OVER () AS w FROM (SELECT model, avg(rmse) AS m FROM cv GROUP BY model))", "weight", "model"), PAIRED, CV))
def ensemble_weights(spark, sf):
    from ..operators.train import weights

    return rounded(weights(cv_results(spark, sf).groupBy("model").agg(F.avg("rmse").alias("mean_rmse")), "mean_rmse", inverse=True).select("model", "weight"))


@book.add("prj11_weighted_ensemble", sql(rounded_sql("SELECT t, i, j, (0.6*tmmn+0.3*tmmx)/0.9 AS prediction FROM signal", "prediction", "t i j")))
def weighted_ensemble(spark, sf):
    from ..operators.train import ensemble

    return rounded(signal(spark, sf).select("t", "i", "j", ensemble({"tmmn": 0.6, "tmmx": 0.3}).alias("prediction")))


@book.add("prj12_mean_ensemble", sql(rounded_sql("SELECT t, i, j, CASE WHEN value IS NULL THEN other WHEN other IS NULL THEN value ELSE (value+other)/2 END AS prediction FROM signal LEFT JOIN second USING (t, i, j)", "prediction", "t i j")))
def mean_ensemble(spark, sf):
    from ..operators.train import mean_of

    return rounded(signal(spark, sf).join(second(spark, sf), ["t", "i", "j"], "left").select("t", "i", "j", mean_of(["value", "other"]).alias("prediction")))


@book.add("agg25_block_distances", sql(rounded_sql("SELECT a.b AS a, c.b AS b, sqrt((a.x-c.x)**2+(a.y-c.y)**2) AS degrees, 111*sqrt((a.x-c.x)**2+(a.y-c.y)**2) AS km, sqrt((a.x-c.x)**2+(a.y-c.y)**2) > 1.0 AS clean FROM bc a JOIN bc c ON a.b < c.b", "degrees km", "a b clean"), "bc AS (SELECT (i//10)*2+j//10 AS b, avg(28.525+0.05*i) AS x, avg(-113.975+0.05*j) AS y FROM cells GROUP BY 1)"))
def block_distances(spark, sf):
    c = observed(spark, sf).select("i", "j").distinct().groupBy((F.floor(F.col("i") / 10) * 2 + F.floor(F.col("j") / 10)).alias("b")).agg(F.avg(28.525 + 0.05 * F.col("i")).alias("x"), F.avg(-113.975 + 0.05 * F.col("j")).alias("y"))
    p, q = c.toDF("a", "ax", "ay"), c.toDF("b", "bx", "by")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return rounded(p.join(F.broadcast(q), F.col("a") < F.col("b")).select("a", "b", d.alias("degrees"), (111 * d).alias("km"), (d > 1.0).alias("clean")))  # one row for each block


@book.add("agg26_monthly_trends", sql(rounded_sql("SELECT t % 12 + 1 AS month, 1995 + t // 12 AS year, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, avg(value) AS mean, count(*) AS n FROM fine GROUP BY 1, 2", "median q25 q75 mean", "month year n")))
def monthly_trends(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = observed(spark, sf).groupBy((F.col("t") % 12 + 1).alias("month"), (1995 + F.floor(F.col("t") / 12)).alias("year")).agg(q.alias("q"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("month", "year", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "mean", "n"))


@book.add("join08_years_matched", sql(rounded_sql("SELECT month, year, a-b AS difference FROM (SELECT t % 12 + 1 AS month, 1995 + t // 12 AS year, avg(value) AS a FROM fine GROUP BY 1, 2) JOIN (SELECT t % 12 + 1 AS month, 1995 + t // 12 AS year, avg(other) AS b FROM second GROUP BY 1, 2) USING (month, year)", "difference", "month year")))
def years_matched(spark, sf):
    def by_year(df, value, out):
        return df.groupBy((F.col("t") % 12 + 1).alias("month"), (1995 + F.floor(F.col("t") / 12)).alias("year")).agg(F.avg(value).alias(out))

    return rounded(by_year(observed(spark, sf), "value", "a").join(by_year(second(spark, sf), "other", "b"), ["month", "year"]).select("month", "year", (F.col("a") - F.col("b")).alias("difference")))


@book.add("agg38_trend_rollup", sql(rounded_sql("SELECT month, avg(m) AS mean_median, count(*) AS years FROM (SELECT t % 12 + 1 AS month, t // 12 AS year, quantile_cont(value, 0.5) AS m FROM fine GROUP BY 1, 2) GROUP BY month", "mean_median", "month years")))
def trend_rollup(spark, sf):
    return rounded(monthly_trends(spark, sf).groupBy("month").agg(F.avg("median").alias("mean_median"), F.count(F.lit(1)).alias("years")))


@book.add("agg27_climatology", sql(rounded_sql("SELECT t % 12 + 1 AS month, i, j, avg(value) AS value FROM fine GROUP BY 1, 2, 3", "value", "month i j")))
def climatology(spark, sf):
    return rounded(observed(spark, sf).groupBy((F.col("t") % 12 + 1).alias("month"), "i", "j").agg(F.avg("value").alias("value")))


@book.add("agg28_axis_limits", sql(rounded_sql("SELECT a-0.05*(b-a) AS lo, b+0.05*(b-a) AS hi FROM (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM fine)", "lo hi")))
def axis_limits(spark, sf):
    q = observed(spark, sf).agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q")).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    return rounded(q.select((F.col("a") - 0.05 * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + 0.05 * (F.col("b") - F.col("a"))).alias("hi")))


_SCALE = "u AS (UNPIVOT (SELECT pr, tmmn, tmmx, aet, chirps FROM fine) ON pr, tmmn, tmmx, aet, chirps INTO NAME feature VALUE v), fs AS (SELECT feature, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, max(v)-min(v) AS spread, avg(abs(v)) AS abs_mean FROM u GROUP BY feature)"


@book.add("agg34_feature_scales", sql(rounded_sql("SELECT feature, min, max, mean, std, spread, abs_mean, (spread-avg(spread) OVER ())/stddev_pop(spread) OVER () AS z, abs((spread-avg(spread) OVER ())/stddev_pop(spread) OVER ()) > 2 AS outlier FROM fs", "min max mean std spread abs_mean z", "feature outlier"), _SCALE))
def feature_scales(spark, sf):
    names = ["pr", "tmmn", "tmmx", "aet", "chirps"]
    u = observed(spark, sf).select(*names).unpivot([], names, "feature", "v")
    s = u.groupBy("feature").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("spread"), F.avg(F.abs("v")).alias("abs_mean"))
    a = s.agg(F.avg("spread").alias("_m"), F.stddev_pop("spread").alias("_s"))
    z = (F.col("spread") - F.col("_m")) / F.col("_s")
    return rounded(s.crossJoin(F.broadcast(a)).select("feature", "min", "max", "mean", "std", "spread", "abs_mean", z.alias("z"), (F.abs(z) > 2).alias("outlier")))


@book.add("agg36_prediction_correlation", sql(rounded_sql("SELECT corr(value, other) AS c12, corr(value, pr) AS c13, corr(other, pr) AS c23, max(value)-min(value) AS r1, max(other)-min(other) AS r2 FROM fine JOIN second USING (t, i, j)", "c12 c13 c23 r1 r2")))
def prediction_correlation(spark, sf):
    x = paired(spark, sf)
    return rounded(x.agg(F.corr("value", "other").alias("c12"), F.corr("value", "pr").alias("c13"), F.corr("other", "pr").alias("c23"), (F.max("value") - F.min("value")).alias("r1"), (F.max("other") - F.min("other")).alias("r2")))


@book.add("agg42_quality_class", sql("SELECT i, j, CASE WHEN q > 0.95 THEN 'excellent' WHEN q > 0.90 THEN 'very good' WHEN q > 0.80 THEN 'good' WHEN q > 0.70 THEN 'fair' ELSE 'poor' END AS class FROM (SELECT i, j, 1.0*count(value)/count(*) AS q FROM signal GROUP BY i, j)"))
def quality_class(spark, sf):
    q = signal(spark, sf).groupBy("i", "j").agg((F.count("value") / F.count(F.lit(1))).alias("q"))
    c = F.col("q")
    return q.select("i", "j", F.when(c > 0.95, "excellent").when(c > 0.90, "very good").when(c > 0.80, "good").when(c > 0.70, "fair").otherwise("poor").alias("class"))


# trial log: a study is a return flag, trials in order of the line items
TRIALS = """tr AS (SELECT l_returnflag AS study, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS trial, CASE WHEN l_linestatus = 'O' THEN 'complete' WHEN l_quantity > 25 THEN 'failed' ELSE 'pruned' END AS state, l_discount + l_tax AS value, l_quantity AS depth, l_shipdate AS started FROM lineitem),
rb AS (SELECT *, max(value) OVER (PARTITION BY study ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best FROM tr WHERE state = 'complete')"""


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "started"]


def trials(spark, sf):
    """The log, with the columns that order it."""
    state = F.when(F.col("l_linestatus") == "O", "complete").when(F.col("l_quantity") > 25, "failed").otherwise("pruned")
    columns = F.col("l_returnflag").alias("study"), state.alias("state"), (F.col("l_discount") + F.col("l_tax")).alias("value"), F.col("l_quantity").alias("depth"), F.col("l_shipdate").alias("started")
    return read(spark, sf, "lineitem").select(*columns, *_ORDER[:-1])


def complete_trials(spark, sf, running=None):
    """Complete trials by their number in the study; other trials are numbered too."""
    log = trials(spark, sf).withColumn("done", F.when(F.col("state") == "complete", F.col("value")))
    return numbered(log, ["study"], _ORDER, "trial", running).where("state = 'complete'").drop(*_ORDER, "done")


@book.add("agg30_trial_outcomes", "WITH " + TRIALS + rounded_sql("SELECT study, 100.0*count(*) FILTER (WHERE state='failed')/count(*) AS failed, 100.0*count(*) FILTER (WHERE state='pruned')/count(*) AS pruned, 100.0*count(*) FILTER (WHERE state='complete')/count(*) AS success FROM tr GROUP BY study", "failed pruned success", "study"))
def trial_outcomes(spark, sf):
    share = lambda s: (100.0 * F.count_if(F.col("state") == s) / F.count(F.lit(1)))
    return rounded(trials(spark, sf).groupBy("study").agg(share("failed").alias("failed"), share("pruned").alias("pruned"), share("complete").alias("success")))


@book.add("agg31_study_metadata", "WITH " + TRIALS + rounded_sql("SELECT study, count(*) AS trials, max(CASE WHEN state='complete' THEN value END) AS best, date_diff('day', min(started), max(started)) AS elapsed_days FROM tr GROUP BY study", "best", "study trials elapsed_days"))
def study_metadata(spark, sf):
    return rounded(trials(spark, sf).groupBy("study").agg(F.count(F.lit(1)).alias("trials"), F.max(F.when(F.col("state") == "complete", F.col("value"))).alias("best"), F.datediff(F.max("started"), F.min("started")).alias("elapsed_days")))


@book.add("agg32_parameter_bins", "WITH " + TRIALS + " SELECT study, CAST(least(floor((depth-lo)/(hi-lo)*20), 19) AS INT) AS bin, count(*) AS n FROM tr JOIN (SELECT study, min(depth) AS lo, max(depth) AS hi FROM tr GROUP BY study) USING (study) GROUP BY 1, 2")
def parameter_bins(spark, sf):
    t = trials(spark, sf)
    ends = t.groupBy("study").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    b = F.least(F.floor((F.col("depth") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)).cast("int")
    return t.join(ends, "study").groupBy("study", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@book.add("agg33_tuning_summary", "WITH " + TRIALS + rounded_sql("SELECT study, count(*) AS trials, count(*) FILTER (WHERE state='complete') AS completed, max(value) AS best, avg(value) AS mean, stddev_samp(value) AS std FROM tr GROUP BY study", "best mean std", "study trials completed"))
def tuning_summary(spark, sf):
    return rounded(trials(spark, sf).groupBy("study").agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("state") == "complete").alias("completed"), F.max("value").alias("best"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))


def running_best(spark, sf):
    return complete_trials(spark, sf, {"best": "done"})


@book.add("win08_plateau", "WITH " + TRIALS + ", q AS (SELECT study, count(*) AS n, max(trial) AS last, max(best) AS top FROM rb GROUP BY study) SELECT study, n > 50 AND top-max(CASE WHEN trial <= 0.75*last THEN best END) < 0.001*abs(top) AS plateau FROM rb JOIN q USING (study) GROUP BY study, n, top")
def plateau(spark, sf):
    r = running_best(spark, sf)
    q = r.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.max("trial").alias("last"), F.max("best").alias("top"))
    return r.join(F.broadcast(q), "study").groupBy("study", "n", "top").agg(F.max(F.when(F.col("trial") <= 0.75 * F.col("last"), F.col("best"))).alias("early")).select("study", ((F.col("n") > 50) & (F.col("top") - F.col("early") < 0.001 * F.abs("top"))).alias("plateau"))


@book.add("win09_efficiency", "WITH " + TRIALS + ", q AS (SELECT study, count(*) AS n, arg_min(best, trial) AS first, max(best) AS top FROM rb GROUP BY study)" + rounded_sql("SELECT study, min(trial) AS trials_to_90, 1.0*min(trial)/any_value(n) AS ratio FROM rb JOIN q USING (study) WHERE best >= first+0.9*(top-first)-1e-12 GROUP BY study", "ratio", "study trials_to_90"))
def efficiency(spark, sf):
    r = running_best(spark, sf)
    q = r.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.min_by("best", "trial").alias("first"), F.max("best").alias("top"))
    x = r.join(F.broadcast(q), "study").where(F.col("best") >= F.col("first") + 0.9 * (F.col("top") - F.col("first")) - 1e-12)
    return rounded(x.groupBy("study").agg(F.min("trial").alias("trials_to_90"), (F.min("trial") / F.first("n")).alias("ratio")))


@book.add("srt04_best_trial", "WITH " + TRIALS + rounded_sql("SELECT study, arg_max(trial, (value, -trial)) AS trial, max(value) AS value FROM tr WHERE state = 'complete' GROUP BY study", "value", "study trial"))
def best_trial(spark, sf):
    return rounded(complete_trials(spark, sf).groupBy("study").agg(F.max_by("trial", F.struct("value", -F.col("trial"))).alias("trial"), F.max("value").alias("value")))


@book.add("join15_parameter_changes", "WITH " + TRIALS + ", d AS (SELECT * FROM (VALUES ('A', 20.0::DOUBLE), ('N', 25.5::DOUBLE), ('X', 1.0::DOUBLE)) x(study, base))" + rounded_sql("SELECT coalesce(m.study, d.study) AS study, base, tuned, 100*(tuned-base)/base AS pct, coalesce(tuned <> base, true) AS changed FROM (SELECT study, avg(depth) AS tuned FROM tr GROUP BY study) m FULL OUTER JOIN d ON m.study = d.study", "base tuned pct", "study changed"))
def parameter_changes(spark, sf):
    base = spark.createDataFrame([("A", 20.0), ("N", 25.5), ("X", 1.0)], "study string, base double")
    x = trials(spark, sf).groupBy("study").agg(F.avg("depth").alias("tuned")).join(base, "study", "full_outer")
    return rounded(x.select("study", "base", "tuned", (100 * (F.col("tuned") - F.col("base")) / F.col("base")).alias("pct"), F.coalesce(F.col("tuned") != F.col("base"), F.lit(True)).alias("changed")))


@book.add("srt06_even_sample", sql("SELECT t, i, j, round(value + 1e-7, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t, j) AS r FROM fine) WHERE r % 50 = 1"))
def even_sample(spark, sf):
    r = F.row_number().over(Window.partitionBy("i").orderBy("t", "j"))
    return observed(spark, sf).withColumn("r", r).where("r % 50 = 1").select("t", "i", "j", r6("value"))


