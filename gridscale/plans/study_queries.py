"""Queries over training tables with the signal, buffers, studies and attribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anova, attribute, folds, parzen, study, train
from ..operators.coarsen import coarsen
from ..operators.metrics import regression
from ..sources.bind import FACTOR, SIDE, observed, read, signal, sql, static
from .book import Book
from .fit_queries import FEATURES, PHI, phi, training
from .metric_queries import TRIALS, rounded, rounded_sql, trials

book = Book()


@book.add("ml01_training_with_signal", sql(rounded_sql("SELECT t, i, j, y, pr, tmmx, aet, elevation, lat FROM (SELECT t, i//5 AS i, j//5 AS j, avg(pr) AS pr, avg(tmmx) AS tmmx, avg(aet) AS aet, avg(elevation) AS elevation, avg(28.525+0.05*i) AS lat FROM fine LEFT JOIN static USING (i, j) GROUP BY 1, 2, 3) JOIN (SELECT t, i//5 AS i, j//5 AS j, avg(value) AS y FROM signal GROUP BY 1, 2, 3) USING (t, i, j) WHERE y IS NOT NULL AND pr IS NOT NULL AND tmmx IS NOT NULL AND aet IS NOT NULL AND elevation IS NOT NULL", "y pr tmmx aet elevation lat", "t i j")))
def training_with_signal(spark, sf):
    """Coarse features joined with the signal on month and cell; complete cases only."""
    x = observed(spark, sf).join(static(spark, sf), ["i", "j"], "left").withColumn("lat", 28.525 + 0.05 * F.col("i"))
    features = coarsen(x, FACTOR, {c: "mean" for c in FEATURES}, SIDE, SIDE)
    y = coarsen(signal(spark, sf), FACTOR, {"value": "mean"}, SIDE, SIDE).withColumnRenamed("value", "y")
    return rounded(features.join(y, ["t", "ci", "cj"]).dropna(subset=["y", *FEATURES]).withColumnsRenamed({"ci": "i", "cj": "j"}).select("t", "i", "j", "y", *FEATURES))


#: Buffer sizes in degrees; a cell is 0.05 degrees wide.
BUFFERS = [0.25, 0.5, 1.0, 1.5]
_BLOCKS = """sp AS (SELECT t, i, j, (i//10)*2+j//10 AS sb FROM fine), bc AS (SELECT sb AS fsb, avg(i) AS ci, avg(j) AS cj FROM (SELECT DISTINCT i, j, sb FROM sp) GROUP BY sb), mo AS (SELECT t//21 AS tb, min(t) AS t0, max(t) AS t1 FROM fine GROUP BY 1),
fo AS (SELECT *, fsb*(SELECT count(*) FROM mo)+tb+1 AS fold FROM bc, mo), bu AS (SELECT unnest([0.25, 0.5, 1.0, 1.5]) AS buffer),
ro AS (SELECT buffer, sb, fsb, tb, fold, CASE WHEN sb = fsb AND t BETWEEN t0 AND t1 THEN 'test' WHEN t BETWEEN t0-1 AND t1+1 AND NOT t BETWEEN t0 AND t1 THEN 'temporal_buffer' WHEN 0.05*sqrt((i-ci)**2+(j-cj)**2) < buffer AND sb <> fsb THEN 'spatial_buffer' ELSE 'train' END AS role FROM sp, fo, bu)"""


def _blocks(spark, sf):
    x = observed(spark, sf).select("t", "i", "j", (F.floor(F.col("i") / 10) * 2 + F.floor(F.col("j") / 10)).cast("int").alias("sb"))
    centres = x.select("i", "j", "sb").distinct().groupBy("sb").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))
    spans = x.groupBy(F.floor(F.col("t") / 21).cast("int").alias("tb")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return x, centres, spans


def _composed(spark, sf):
    from functools import reduce

    x, centres, spans = _blocks(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [folds.composition(x, centres, spans, b / 0.05, 1).withColumn("buffer", F.lit(b)) for b in BUFFERS])


@book.add("agg24_buffer_sizes", sql(rounded_sql("SELECT buffer, CAST(fold AS INT) AS fold, count(*) FILTER (WHERE role='train') AS n_train, count(*) FILTER (WHERE role='test') AS n_test, count(*) FILTER (WHERE role LIKE '%buffer') AS n_buffer, 100.0*count(*) FILTER (WHERE role='train')/count(*) AS train_pct, 100.0*count(*) FILTER (WHERE role LIKE '%buffer')/count(*) AS buffer_pct FROM ro GROUP BY 1, 2", "buffer train_pct buffer_pct", "fold n_train n_test n_buffer"), _BLOCKS))
def buffer_sizes(spark, sf):
    n = lambda r: F.count_if(F.col("role").rlike(r))
    share = lambda r: 100.0 * n(r) / F.count(F.lit(1))
    return rounded(_composed(spark, sf).groupBy("buffer", "fold").agg(n("^train").alias("n_train"), n("^test").alias("n_test"), n("buffer").alias("n_buffer"), share("^train").alias("train_pct"), share("buffer").alias("buffer_pct")))


@book.add("agg24_block_overlap", sql(rounded_sql("SELECT buffer, CAST(fsb AS INT) AS test_block, CAST(sb AS INT) AS block, 100.0*count(*) FILTER (WHERE role='spatial_buffer')/count(*) AS overlap_pct FROM ro WHERE sb <> fsb GROUP BY 1, 2, 3", "buffer overlap_pct", "test_block block"), _BLOCKS))
def block_overlap(spark, sf):
    """Share of each other block that a test block's buffer takes."""
    x = _composed(spark, sf).where("sb <> fsb")
    return rounded(x.groupBy("buffer", F.col("fsb").alias("test_block"), F.col("sb").alias("block")).agg((100.0 * F.count_if(F.col("role") == "spatial_buffer") / F.count(F.lit(1))).alias("overlap_pct")))


@book.add("agg39_buffer_summary", sql(rounded_sql("SELECT buffer, avg(tr) AS mean_train, stddev_pop(tr) AS std_train, avg(bu) AS mean_buffer, stddev_pop(bu) AS std_buffer FROM (SELECT buffer, fold, 100.0*count(*) FILTER (WHERE role='train')/count(*) AS tr, 100.0*count(*) FILTER (WHERE role LIKE '%buffer')/count(*) AS bu FROM ro GROUP BY 1, 2) GROUP BY buffer", "buffer mean_train std_train mean_buffer std_buffer"), _BLOCKS))
def buffer_summary(spark, sf):
    share = lambda r: 100.0 * F.count_if(F.col("role").rlike(r)) / F.count(F.lit(1))
    x = _composed(spark, sf).groupBy("buffer", "fold").agg(share("^train").alias("a"), share("buffer").alias("b"))
    return rounded(x.groupBy("buffer").agg(F.avg("a").alias("mean_train"), F.stddev_pop("a").alias("std_train"), F.avg("b").alias("mean_buffer"), F.stddev_pop("b").alias("std_buffer")))


@book.add("agg40_fold_composition", sql("SELECT CAST(fold AS INT) AS fold, role, count(*) AS n FROM ro WHERE buffer = 0.5 GROUP BY 1, 2", _BLOCKS))
def fold_composition(spark, sf):
    x, centres, spans = _blocks(spark, sf)
    return folds.composition(x, centres, spans, 10.0, 1).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


# studies: a trial of each family for every supplier
def _trial_keys(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("trial"))
    return s.withColumn("model", F.explode(F.array(*[F.lit(m) for m in study.SPACES])))


def _space_sql() -> str:
    rows = []
    for m, space in study.SPACES.items():
        for p in space:
            lo, hi, choices = ("NULL", "NULL", "[" + ", ".join(f"'{c}'" for c in p[2]) + "]") if p[1] == "choice" else (f"{float(p[2])!r}::DOUBLE", f"{float(p[3])!r}::DOUBLE", "NULL")
            rows.append(f"('{m}', '{p[0]}', '{p[1]}', {lo}, {hi}, {choices}, {repr(p[4]) if len(p) > 4 else 'NULL'})")
    u = lambda name: f"('0x' || substr(md5(concat_ws('-', model, s_suppkey, {name}, '42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""spec AS (SELECT * FROM (VALUES {', '.join(rows)}) x(model, param, kind, lo, hi, choices, owner)),
dr AS (SELECT model, CAST(s_suppkey AS BIGINT) AS trial, param, kind, lo, hi, choices, owner, {u('param')} AS u, {u("'boosting_type'")} AS b FROM supplier, spec),
sa AS (SELECT model, trial, param, CASE kind WHEN 'int' THEN floor(lo+u*(hi-lo+1)) WHEN 'log' THEN exp(ln(lo)+u*(ln(hi)-ln(lo))) WHEN 'float' THEN lo+u*(hi-lo) END AS number, CASE WHEN kind = 'choice' THEN choices[CAST(floor(u*len(choices)) AS INT)+1] END AS choice
FROM dr WHERE owner IS NULL OR owner = ['gbdt', 'dart', 'goss'][CAST(floor(b*3) AS INT)+1])"""


@book.add("ml15_search_spaces", "WITH " + _space_sql() + " " + rounded_sql("SELECT * FROM sa", "number", "model trial param choice"))
def search_spaces(spark, sf):
    """Every parameter of the three spaces for every trial, drawn repeatably."""
    return rounded(study.sampled(_trial_keys(spark, sf)))


# a trial log from the line items: a study for each supplier
_LOG = "lo AS (SELECT l_suppkey AS study, l_orderkey*10 + l_linenumber AS trial, 1 - 6*l_discount AS r2, 150*l_quantity AS seconds, l_partkey % 13 + 3 AS depth FROM lineitem)"
_OBJECTIVE = "CASE WHEN r2 < 0.5 OR (r2 < 0.65 AND seconds > 3600) OR (seconds > 6480 AND r2 < 0.72) OR seconds > 10800 THEN -999.0 ELSE r2 - 0.05*least(seconds/1800, 0.5) END"


def _log(spark, sf):
    x = read(spark, sf, "lineitem")
    return x.select(F.col("l_suppkey").alias("study"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trial"), (1 - 6 * F.col("l_discount")).alias("r2"), (150 * F.col("l_quantity")).alias("seconds"), (F.col("l_partkey") % 13 + 3).alias("depth"))


@book.add("ml16_time_priced_objective", "WITH " + _LOG + " " + rounded_sql(f"SELECT study, count(*) FILTER (WHERE v = -999) AS failed, max(v) AS best, arg_max(trial, (v, -trial)) AS trial FROM (SELECT *, {_OBJECTIVE} AS v FROM lo) GROUP BY study", "best", "study failed trial"))
def time_priced_objective(spark, sf):
    x = _log(spark, sf).withColumn("v", study.simple_objective(F.col("r2"), F.col("seconds")))
    return rounded(x.groupBy("study").agg(F.count_if(F.col("v") == study.FAILED).alias("failed"), F.max("v").alias("best"), F.max_by("trial", F.struct("v", -F.col("trial"))).alias("trial")))


@book.add("ml17_blocked_objective", "WITH " + _LOG + " " + rounded_sql("SELECT study, depth, avg(r2) - 0.05*least(sum(seconds)/7200, 1.0) AS objective FROM lo GROUP BY 1, 2", "objective", "study depth"))
def blocked_objective(spark, sf):
    """Rows of one depth are the folds of a trial."""
    x = _log(spark, sf).groupBy("study", "depth").agg(F.avg("r2").alias("r2"), F.sum("seconds").alias("seconds"))
    return rounded(x.select("study", "depth", study.blocked_objective(F.col("r2"), F.col("seconds")).alias("objective")))


@book.add("snk05_tuned_parameters", "WITH " + _LOG + " SELECT study, CAST(arg_max(depth, (v, -trial)) AS VARCHAR) AS max_depth, round(max(v) + 1.3e-5, 4) AS value FROM (SELECT *, " + _OBJECTIVE + " AS v FROM lo) GROUP BY study")
def tuned_parameters(spark, sf):
    log = _log(spark, sf).withColumn("value", study.simple_objective(F.col("r2"), F.col("seconds"))).withColumn("params", F.create_map(F.lit("max_depth"), F.col("depth").cast("string")))
    best = study.best_parameters(log, ["study"])
    return best.select("study", F.col("params")["max_depth"].alias("max_depth"), F.round(F.col("value") + 1.3e-5, 4).alias("value"))


@book.add("agg32_parameter_coverage", "WITH " + TRIALS + ", pc AS (SELECT study, 'depth' AS param, var_pop(depth) AS spread FROM tr GROUP BY study HAVING count(*) >= 10 UNION ALL SELECT study, 'value', var_pop(value) FROM tr GROUP BY study HAVING count(*) >= 10 UNION ALL SELECT study, 'state', CAST(count(DISTINCT state) AS DOUBLE) FROM tr GROUP BY study HAVING count(*) >= 10) " + rounded_sql("SELECT study, param, spread, row_number() OVER (PARTITION BY study ORDER BY spread DESC, param) AS rank FROM pc QUALIFY rank <= 4", "spread", "study param rank"))
def parameter_coverage(spark, sf):
    """Variance of numeric parameters and number of values of the others, the four widest of each study."""
    from pyspark.sql.window import Window

    x = trials(spark, sf).groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.var_pop("depth").alias("depth"), F.var_pop("value").alias("value"), F.countDistinct("state").cast("double").alias("state")).where("n >= 10").drop("n")
    long = x.unpivot(["study"], ["depth", "value", "state"], "param", "spread")
    rank = F.row_number().over(Window.partitionBy("study").orderBy(F.desc("spread"), "param"))
    return rounded(long.withColumn("rank", rank).where("rank <= 4").withColumn("rank", F.col("rank").cast("long")))


@book.add("ml18_study")
def run_study(spark, sf):
    """Random search of all three families on the training table, a forest with half as many trials again; fits hold to 12 trees."""
    log = study.run(training(spark, sf), FEATURES, ["t", "i", "j"], list(study.SPACES), 2, most_trees=12, most_depth=5)
    return log.select("model", "trial", "state", "value", "r2", "rmse", "n_folds", "params")


@book.add("ml17_blocked_study")
def run_blocked_study(spark, sf):
    x = training(spark, sf).withColumn("sb", F.floor(F.col("i") / 2).cast("int"))
    centres = x.groupBy("sb").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))
    spans = x.groupBy(F.floor(F.col("t") / 42).cast("int").alias("tb")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    log = study.run(x, FEATURES, ["t", "i", "j"], ["xgb"], 2, folds.roles(x, centres, spans, 0.5, 1).cache(), most_trees=5, most_depth=4)
    return log.select("model", "trial", "state", "value", "r2", "rmse", "n_folds", "params")


@book.add("ml02_registry")
def registry(spark, sf):
    """All families on one split, with a tuned parameter for one; a family that is unknown is told and skipped."""
    x = training(spark, sf)
    x = x.withColumn("_train", train.hash_split(x, ["t", "i", "j"], 0.7)).select("t", "i", "j", *FEATURES, "y", "_train").cache()
    done, failed = train.trained(x.where("_train"), FEATURES, [*train.DEFAULTS, "unheard_of"], {"rf": {"numTrees": 8}, "nn": {"rounds": 8}, "svr": {"rounds": 8}})
    out = None
    for name, model in done.items():
        m = regression(model.transform(x.where("not _train")), "y", "prediction", []).select(F.lit(name).alias("model"), "n", "r2", "rmse", "mae", F.lit(None).cast("string").alias("failure"))
        out = m if out is None else out.unionByName(m)
    none = spark.createDataFrame([(n, None, None, None, None, e) for n, e in failed.items()], "model string, n long, r2 double, rmse double, mae double, failure string")
    return out.unionByName(none)


@book.add("ml04_scaling")
def scaling(spark, sf):
    """The linear model with each way of scaling: the same predictions but for the penalty's weight."""
    x = training(spark, sf).cache()
    out = None
    for way in ("robust", "standard"):
        told = train.pipeline("linear", FEATURES, way).fit(x).transform(x)
        m = regression(told, "y", "prediction", []).select(F.lit(way).alias("scaling"), "n", "r2", "rmse", "mae")
        out = m if out is None else out.unionByName(m)
    return out


@book.add("xai08_extremes", sql(rounded_sql("SELECT model, feature, max(abs(phi)) AS largest, max(abs(phi)) > 1000 AS extreme FROM ph GROUP BY 1, 2", "largest", "model feature extreme"), PHI))
def extremes(spark, sf):
    return rounded(phi(spark, sf).groupBy("model", "feature").agg(F.max(F.abs("phi")).alias("largest")).withColumn("extreme", F.col("largest") > 1000))


@book.add("xai08_scaled_against_plain")
def scaled_against_plain(spark, sf):
    """Predictions of a model on scaled and on plain features, joined by sample: what is missing where the scaler was left out."""
    x = training(spark, sf).cache()
    scaled = train.pipeline("linear", FEATURES, "standard").fit(x)
    inner = scaled.stages[-1]
    a = scaled.transform(x).select("t", "i", "j", F.col("prediction").alias("scaled"))
    b = inner.transform(scaled.stages[0].transform(x).withColumnRenamed("raw", "features")).select("t", "i", "j", F.col("prediction").alias("plain"))
    return a.join(b, ["t", "i", "j"]).withColumn("difference", F.col("plain") - F.col("scaled"))


@book.add("xai09_report", sql(rounded_sql("SELECT model, feature, mean_abs, share, rank, n_features, mean_abs_all, std_abs_all FROM (SELECT model, feature, m AS mean_abs, 100*m/sum(m) OVER w AS share, row_number() OVER (PARTITION BY model ORDER BY m DESC, feature) AS rank, count(*) OVER w AS n_features, avg(m) OVER w AS mean_abs_all, stddev_pop(m) OVER w AS std_abs_all FROM (SELECT model, feature, avg(abs(phi)) AS m FROM ph GROUP BY 1, 2) WINDOW w AS (PARTITION BY model)) WHERE rank <= 10", "mean_abs share mean_abs_all std_abs_all", "model feature rank n_features"), PHI))
def report(spark, sf):
    """The ten weightiest features of each model with their share, and statistics over all of the model's."""
    x = attribute.importance(phi(spark, sf)).select("model", "feature", "mean_abs", "rank")
    s = x.groupBy("model").agg(F.sum("mean_abs").alias("_s"), F.count(F.lit(1)).alias("n_features"), F.avg("mean_abs").alias("mean_abs_all"), F.stddev_pop("mean_abs").alias("std_abs_all"))
    x = x.join(F.broadcast(s), "model").where("rank <= 10")  # a row for each model
    return rounded(x.select("model", "feature", "mean_abs", (100 * F.col("mean_abs") / F.col("_s")).alias("share"), F.col("rank").cast("long").alias("rank"), "n_features", "mean_abs_all", "std_abs_all"))


@book.add("pipe_steps")
def steps_of_the_job(spark, sf):
    """All nine steps, each stored and read again; the metrics of every method and of the product."""
    import uuid

    from ..sources.scratch import shared_folder
    from . import steps

    store = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    fine = observed(spark, sf)
    y = coarsen(fine.withColumn("value", 0.5 * F.col("pr") + 2 * F.col("tmmx")), FACTOR, {"value": "mean"}, SIDE, SIDE).withColumnsRenamed({"ci": "i", "cj": "j"})
    job = steps.Job(spark, store, y, fine.drop("value"), static(spark, sf), models=("rf", "linear", "nn"))
    steps.run(job)
    told = job.read("bake_off").select(F.col("method").alias("product"), "n", "r2", "rmse", "mae")
    return told.unionByName(job.read("metrics").select(F.col("stage").alias("product"), "n", "r2", "rmse", "mae"))


@book.add("join14_block_labels", sql("SELECT t, i, j, CAST((i//10)*2+j//10 AS INT) AS block FROM fine"))
def block_labels(spark, sf):
    """The label of each distinct coordinate, brought back to all samples."""
    x = observed(spark, sf).select("t", "i", "j")
    labels = x.select("i", "j").distinct().withColumn("block", (F.floor(F.col("i") / 10) * 2 + F.floor(F.col("j") / 10)).cast("int"))
    return folds.with_labels(x, labels, ["i", "j"])


@book.add("ts08_fill_run")
def fill_all(spark, sf):
    """Irregular observations brought to months, every cell filled, and how each kind of fill went."""
    from ..operators import grid, series
    from ..sources.bind import month_index

    x = read(spark, sf, "lineitem").select((F.col("l_partkey") % SIDE).cast("int").alias("i"), (F.floor(F.col("l_partkey") / SIDE) % SIDE).cast("int").alias("j"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    monthly = grid.regular_axis(x, ["i", "j"], "ts", "value", "month", "tie").select(month_index(F.col("step")).alias("t"), "i", "j", "value")
    told = series.stl_fill(monthly).groupBy("i", "j").agg(*[F.first(c).alias(c) for c in ("method", "values_filled", "test_r2", "test_rmse")])
    return told.groupBy("method").agg(F.count(F.lit(1)).alias("cells"), F.sum("values_filled").alias("values_filled"), F.avg("test_r2").alias("mean_r2"), F.avg("test_rmse").alias("mean_rmse"))


_SPLITS = """fx AS (SELECT CAST(least(floor(pr/10), 15) AS INT) AS b0, CAST(least(floor(tmmx), 10) AS INT) AS b1, CAST(least(chirps, 8) AS INT) AS b2, (SELECT avg(0.5*pr + 2*tmmx) FROM fine) - (0.5*pr + 2*tmmx) AS g FROM fine),
l0 AS (SELECT 0 AS node, * FROM fx),
s0 AS ({}), l1 AS (SELECT CASE WHEN CASE s.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= s.bin THEN 1 ELSE 2 END AS node, b0, b1, b2, g FROM fx, s0 s), s1 AS ({})"""
_LEVEL = """SELECT node, feature, bin, gain, n_left, n_right FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS r FROM (
    SELECT node, feature, bin, CAST(nl AS BIGINT) AS n_left, CAST(n - nl AS BIGINT) AS n_right, round(0.5*(gl*gl/(nl + 1) + (gs - gl)*(gs - gl)/(n - nl + 1) - gs*gs/(n + 1)), 3) AS gain FROM (
      SELECT node, feature, bin, sum(g) OVER b AS gl, sum(n) OVER b AS nl, sum(g) OVER w AS gs, sum(n) OVER w AS n FROM (
        SELECT node, feature, bin, sum(g) AS g, count(*) AS n FROM (
          SELECT node, 0 AS feature, b0 AS bin, g FROM {0} UNION ALL SELECT node, 1, b1, g FROM {0} UNION ALL SELECT node, 2, b2, g FROM {0})
        GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY node, feature), b AS (PARTITION BY node, feature ORDER BY bin))
    WHERE nl >= 20 AND n - nl >= 20)) WHERE r = 1"""


@book.add("ml02_level_splits", sql("SELECT CAST(node AS INT) AS node, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(gain, 2) AS gain, n_left, n_right FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)", _SPLITS.format(_LEVEL.format("l0"), _LEVEL.format("l1"))))
def level_splits(spark, sf):
    """The splits of the first two levels of the first boosted tree, by histograms of gradients over given bins."""
    import numpy as np

    from ..operators.boost import Boosting, Params

    x = observed(spark, sf).withColumn("y", 0.5 * F.col("pr") + 2 * F.col("tmmx"))
    fit = Boosting(x, ["pr", "tmmx", "chirps"], Params(depth=2, least_rows=20), [np.arange(10.0, 151, 10), np.arange(1.0, 11), np.arange(1.0, 9)])
    nodes = fit.grow(0, fit._gradients()).nodes
    fit.written.drop()
    rows = [(k, n.feature, n.bin, round(n.gain, 2), int(n.sums[n.feature, : n.bin + 1, 2].sum()), int(n.sums[n.feature, n.bin + 1 :, 2].sum())) for k, n in enumerate(nodes) if n.accepted]
    return spark.createDataFrame(rows, "node int, feature int, bin int, gain double, n_left long, n_right long")


_DENSITY = """pr AS (SELECT study, depth, row_number() OVER (PARTITION BY study ORDER BY r2 DESC, trial) <= least(ceil(0.2*count(*) OVER (PARTITION BY study)), 25) AS good FROM lo),
sd AS (SELECT study, good, count(*) AS n FROM pr GROUP BY 1, 2), ca AS (SELECT study, x, b.good FROM (SELECT DISTINCT study FROM lo), (SELECT unnest(range(3, 16)) AS x), (VALUES (true), (false)) b(good)),
de AS (SELECT c.study, c.x, c.good, (CAST(1 AS DOUBLE)/12 + coalesce(sum(exp(-0.5*pow((c.x - p.depth)*sqrt(coalesce(s.n, 0) + 1)/12, 2))), 0)*sqrt(coalesce(s.n, 0) + 1)/CAST(30.079539295572 AS DOUBLE))/(coalesce(s.n, 0) + 1) AS d
FROM ca c LEFT JOIN sd s USING (study, good) LEFT JOIN pr p ON p.study = c.study AND p.good = c.good GROUP BY c.study, c.x, c.good, s.n)"""


@book.add("ml18_parzen_densities", "WITH " + _LOG + ", " + _DENSITY + " " + rounded_sql("SELECT study, CAST(x AS INT) AS depth, max(CASE WHEN good THEN d END) AS l, max(CASE WHEN NOT good THEN d END) AS g FROM de GROUP BY 1, 2", "l g", "study depth"))
def parzen_densities(spark, sf):
    """Densities of a parameter's values under the good and the other trials of each study."""
    log = parzen.parted(_log(spark, sf), ["study"], "r2")
    candidates = log.select("study").distinct().withColumn("depth", F.explode(F.sequence(F.lit(3), F.lit(15))))
    return rounded(parzen.densities(log, candidates, ["study"], "depth", 3, 15))


_STEPS = """sv AS (SELECT l_orderkey // 64 AS study, l_orderkey AS trial, l_linenumber AS step, avg(1 - 6*l_discount) AS v FROM lineitem GROUP BY 1, 2, 3),
rn AS (SELECT study, trial, step, round(avg(v) OVER (PARTITION BY trial ORDER BY step), 9) AS value FROM sv),
md AS (SELECT study, step, quantile_cont(value, 0.5) AS median, count(*) AS n FROM rn WHERE trial % 2 = 0 GROUP BY 1, 2)"""


@book.add("ml18_median_pruning", "WITH " + _STEPS + " SELECT study, trial, CAST(step AS INT) AS step, round(value, 6) AS value, round(median, 6) AS median, coalesce(step > 1 AND n >= 4 AND value < median, false) AS pruned FROM rn LEFT JOIN md USING (study, step) WHERE trial % 2 = 1")
def median_pruning(spark, sf):
    """Running trials against the median of the finished ones of their study, step by step."""
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    keys = F.floor(F.col("l_orderkey") / 64).cast("long").alias("study"), F.col("l_orderkey").alias("trial"), F.col("l_linenumber").cast("int").alias("step")
    x = read(spark, sf, "lineitem").groupBy(*keys).agg(F.avg(1 - 6 * F.col("l_discount")).alias("v"))
    x = x.withColumn("value", F.round(F.avg("v").over(so_far), 9)).drop("v")
    told = parzen.below_median(x.where("trial % 2 = 1"), x.where("trial % 2 = 0"), ["study"])
    return told.select("study", "trial", "step", F.round("value", 6).alias("value"), F.round("median", 6).alias("median"), "pruned")


def _folds(spark, sf):
    x = training(spark, sf).withColumn("sb", F.floor(F.col("i") / 2).cast("int"))
    centres = x.groupBy("sb").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))
    spans = x.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).withColumn("tb", F.lit(0))
    return folds.roles(x, centres, spans, 0.5, 1)


def _study(spark, table, model, n, **most):
    """A study of ``n`` trials over a table with folds, which is written once for all of them."""
    import uuid

    from ..sources.scratch import Written, shared_folder

    objective = parzen.model_objective(model, Written(table).table, FEATURES, **most)
    return parzen.Study(spark, f"{shared_folder(spark)}/study-{uuid.uuid4().hex}", model, study.SPACES[model]).run(objective, n)


@book.add("ml18_adaptive_study")
def adaptive_study(spark, sf):
    """A study of boosters over blocked folds, with pruning and a stored trial table."""
    return _study(spark, _folds(spark, sf), "xgb", 4, most_trees=3, most_depth=3).select("study", "trial", "state", "value", F.size("steps").alias("n_steps"), "params")


@book.add("ml19_parameter_importance")
def parameter_importance(spark, sf):
    """How much each parameter that a study searched tells about its objective."""
    x = training(spark, sf)
    one = x.withColumn("fold", F.lit(1)).withColumn("role", F.when(train.hash_split(x, ["t", "i", "j"], 0.7), "train").otherwise("test"))
    return anova.parameter_importance(_study(spark, one, "rf", 8, most_trees=3, most_depth=4), study.SPACES["rf"], 8, 4)


_CELLS = """cl AS (SELECT l_suppkey AS tree, l_linenumber % 4 AS a, l_partkey % 5 AS b, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3), wh AS (SELECT tree, sum(value)/20.0 AS m, sum(value*value)/20.0 - pow(sum(value)/20.0, 2) AS total FROM cl GROUP BY tree),
ma AS (SELECT tree, 'a' AS param, a AS k, sum(value)/5.0 AS mean, 0.25 AS width FROM cl GROUP BY tree, a UNION ALL SELECT tree, 'b', b, sum(value)/4.0, 0.2 FROM cl GROUP BY tree, b)"""


@book.add("ml19_marginals", "WITH " + _CELLS + " " + rounded_sql("SELECT CAST(tree AS BIGINT) AS tree, param, CASE WHEN total > 1e-12 THEN sum(width*pow(mean - m, 2))/total ELSE 0.0 END AS share FROM ma JOIN wh USING (tree) GROUP BY tree, param, total", "share", "tree param"))
def box_marginals(spark, sf):
    """Shares of variance of two parameters over boxes whose values come from the line items of each supplier."""
    x = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tree"), (F.col("l_linenumber") % 4).alias("a"), (F.col("l_partkey") % 5).alias("b")).agg(F.avg("l_quantity").alias("value"))
    side = lambda c, n: F.struct(F.lit(c).alias("param"), (F.col(c) / n).alias("lo"), ((F.col(c) + 1) / n).alias("hi"))
    boxes = x.select("tree", (F.col("a") * 5 + F.col("b")).alias("leaf"), F.explode(F.array(side("a", 4), side("b", 5))).alias("s"), "value").select("tree", "leaf", "s.*", "value")
    return rounded(anova.shares(boxes).select(F.col("tree").cast("long").alias("tree"), "param", "share"))
