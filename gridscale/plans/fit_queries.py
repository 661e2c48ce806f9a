"""Queries over folds, models and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribute, folds, shap, study, train
from ..operators.coarsen import coarsen
from ..operators.gradient import Network, svr
from ..operators.metrics import regression
from ..sources.bind import FACTOR, SIDE, observed, signal, sql, static
from .book import Book
from .metric_queries import rounded, rounded_sql

book = Book()
FEATURES = ["pr", "tmmx", "aet", "elevation", "lat"]


def training(spark, sf):
    """Coarse features with a target that depends on them and on a hash of the key."""
    x = observed(spark, sf).join(static(spark, sf), ["i", "j"]).withColumn("lat", 28.525 + 0.05 * F.col("i"))
    c = coarsen(x, FACTOR, {"pr": "mean", "tmmx": "mean", "aet": "mean", "elevation": "mean", "lat": "mean"}, SIDE, SIDE)
    noise = F.pmod(F.xxhash64("t", "ci", "cj"), F.lit(1000)) / 1000.0
    return c.withColumn("y", 0.5 * F.col("pr") + 2 * F.col("tmmx") - 0.1 * F.col("lat") + noise).withColumnsRenamed({"ci": "i", "cj": "j"})


@book.add("ml01_training_table", sql(rounded_sql("SELECT t, i//5 AS i, j//5 AS j, avg(pr) AS pr, avg(tmmx) AS tmmx, avg(aet) AS aet, avg(elevation) AS elevation, avg(28.525+0.05*i) AS lat FROM fine JOIN static USING (i, j) GROUP BY 1, 2, 3", "pr tmmx aet elevation lat", "t i j")))
def training_table(spark, sf):
    return rounded(training(spark, sf).drop("y").select("t", "i", "j", *FEATURES))


@book.add("ml05_spatial_blocks")
def spatial_blocks(spark, sf):
    return folds.spatial_blocks(observed(spark, sf), 5)


_ROLES = """sp AS (SELECT t, i, j, (i//10)*2+j//10 AS sb FROM fine), fo AS (SELECT s.sb AS fsb, ci, cj, tb, t0, t1 FROM (SELECT sb, avg(i) AS ci, avg(j) AS cj FROM (SELECT DISTINCT i, j, sb FROM sp) GROUP BY sb) s, (SELECT t//21 AS tb, min(t) AS t0, max(t) AS t1 FROM fine GROUP BY 1) m),
ro AS (SELECT t, i, j, fsb*(SELECT count(DISTINCT tb) FROM fo)+tb+1 AS fold, CASE WHEN sb = fsb AND t BETWEEN t0 AND t1 THEN 'test' WHEN (t BETWEEN t0-1 AND t1+1 AND NOT t BETWEEN t0 AND t1) OR (sqrt((i-ci)**2+(j-cj)**2) < 6 AND sb <> fsb) THEN 'buffer' ELSE 'train' END AS role FROM sp, fo)"""


def role_table(spark, sf):
    x = observed(spark, sf).select("t", "i", "j", (F.floor(F.col("i") / 10) * 2 + F.floor(F.col("j") / 10)).cast("int").alias("sb"))
    centres = x.select("i", "j", "sb").distinct().groupBy("sb").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))
    spans = x.groupBy(F.floor(F.col("t") / 21).cast("int").alias("tb")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return folds.roles(x, centres, spans, 6.0, 1)


@book.add("ml07_fold_roles", sql("SELECT CAST(fold AS INT) AS fold, role, count(*) AS n FROM ro GROUP BY 1, 2", _ROLES))
def fold_roles(spark, sf):
    return role_table(spark, sf).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@book.add("agg24_buffer_audit", sql(rounded_sql("SELECT CAST(fold AS INT) AS fold, 100.0*count(*) FILTER (WHERE role='train')/count(*) AS train_pct, 100.0*count(*) FILTER (WHERE role='buffer')/count(*) AS buffer_pct FROM ro GROUP BY 1", "train_pct buffer_pct", "fold"), _ROLES))
def buffer_audit(spark, sf):
    share = lambda r: 100.0 * F.count_if(F.col("role") == r) / F.count(F.lit(1))
    return rounded(role_table(spark, sf).groupBy("fold").agg(share("train").alias("train_pct"), share("buffer").alias("buffer_pct")))


@book.add("agg39_buffer_sensitivity", sql("SELECT k AS tenth_degrees, count(*) FILTER (WHERE d < 0.2*k) AS conflicts FROM (SELECT 0.05*sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM bc a JOIN bc b ON a.sb <> b.sb), (SELECT CAST(unnest(range(1, 21)) AS INT) AS k) GROUP BY k", "bc AS (SELECT (i//10)*2+j//10 AS sb, avg(i) AS x, avg(j) AS y FROM cells GROUP BY 1)"))
def buffer_sensitivity(spark, sf):
    c = observed(spark, sf).select("i", "j").distinct().groupBy((F.floor(F.col("i") / 10) * 2 + F.floor(F.col("j") / 10)).alias("a")).agg(F.avg("i").alias("ax"), F.avg("j").alias("ay"))
    d = 0.05 * F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = c.join(F.broadcast(c.toDF("b", "bx", "by")), F.col("a") != F.col("b")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))  # one row for each block
    return pairs.groupBy(F.col("k").alias("tenth_degrees")).agg(F.count_if(d < 0.2 * F.col("k")).alias("conflicts"))


@book.add("agg41_fold_periods", sql("SELECT CAST(tb AS INT) AS tb, min(t) AS first, max(t) AS last FROM (SELECT t, t//21 AS tb FROM fine) GROUP BY tb"))
def fold_periods(spark, sf):
    return observed(spark, sf).groupBy(F.floor(F.col("t") / 21).cast("int").alias("tb")).agg(F.min("t").alias("first"), F.max("t").alias("last"))


@book.add("ml11_simple_validation")
def simple_validation(spark, sf):
    return train.simple_validation(training(spark, sf), FEATURES, ["rf", "xgb", "linear"], ["t", "i", "j"])


@book.add("ml09_blocked_validation")
def blocked_validation(spark, sf):
    x = training(spark, sf).withColumn("sb", F.floor(F.col("i") / 2).cast("int"))
    centres = x.groupBy("sb").agg(F.avg("i").alias("ci"), F.avg("j").alias("cj"))
    spans = x.groupBy(F.floor(F.col("t") / 42).cast("int").alias("tb")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return train.blocked_validation(folds.roles(x, centres, spans, 0.5, 1).cache(), FEATURES, ["linear"])


@book.add("ml14_prediction")
def prediction(spark, sf):
    """Models fitted on the coarse grid, predicting on the fine grid, with their mean."""
    coarse = training(spark, sf).cache()
    fine = observed(spark, sf).join(static(spark, sf), ["i", "j"]).withColumn("lat", 28.525 + 0.05 * F.col("i")).select("t", "i", "j", *FEATURES)
    for name in ("rf", "linear"):
        told = train.pipeline(name, FEATURES).fit(coarse).transform(fine)
        fine = told.withColumnRenamed("prediction", f"prediction_{name}").drop("features", "raw")
    return fine.withColumn("prediction_ensemble", train.mean_of(["prediction_rf", "prediction_linear"])).select("t", "i", "j", "prediction_rf", "prediction_linear", "prediction_ensemble")


@book.add("ml15_search")
def search(spark, sf):
    """Random search over a family's whole space, each trial fitted and scored on one repeatable split."""
    log = study.run(training(spark, sf), FEATURES, ["t", "i", "j"], ["rf"], 3, most_trees=4, most_depth=4)
    return log.select("model", "trial", "state", "r2", "rmse", "params")


def _forest(spark, sf):
    x = training(spark, sf).withColumn("sample_id", F.concat_ws("-", "t", "i", "j"))
    return train.pipeline("rf", FEATURES, numTrees=10, maxDepth=5).fit(x), x


@book.add("xai01_attributions")
def attributions(spark, sf):
    """Exact attributions of every sample by the trees' own paths."""
    return shap.tree_attributions(*_forest(spark, sf), FEATURES)[0]


@book.add("xai02_interactions")
def interactions(spark, sf):
    """The ten strongest pairs by exact interaction values over all samples."""
    return shap.tree_interactions(*_forest(spark, sf), FEATURES).orderBy(F.desc("strength")).limit(10)


#: Samples that the sampling explainer looks at, and background rows it holds them against, at most.
EXPLAINED, BACKGROUND = 1000, 100


@book.add("xai01_sampled")
def sampled_attributions(spark, sf):
    """Attributions of a model that is no tree, by sampled permutations against background rows."""
    x = training(spark, sf).withColumn("sample_id", F.concat_ws("-", "t", "i", "j"))
    model = train.pipeline("linear", FEATURES).fit(x)
    samples = x.orderBy(F.md5("sample_id")).limit(EXPLAINED)
    background = x.orderBy(F.md5(F.concat_ws("-", "sample_id", F.lit("b")))).limit(BACKGROUND)
    return attribute.shapley(model, samples, background, FEATURES, rounds=BACKGROUND)[0]


# attribution tables of two models, derived from the data, for the summaries that SQL can check
PHI = "phi AS (SELECT 'a' AS model, t*400+i*20+j AS sample_id, u.feature, v, (v-m)/100 AS phi FROM (UNPIVOT (SELECT t, i, j, pr, tmmx, aet, chirps FROM fine) ON pr, tmmx, aet, chirps INTO NAME feature VALUE v) u JOIN (SELECT feature, avg(v) AS m FROM (UNPIVOT (SELECT pr, tmmx, aet, chirps FROM fine) ON pr, tmmx, aet, chirps INTO NAME feature VALUE v) GROUP BY feature) USING (feature)), ph AS (SELECT * FROM phi UNION ALL SELECT 'b', sample_id, feature, v, phi*phi FROM phi)"


def phi(spark, sf):
    names = ["pr", "tmmx", "aet", "chirps"]
    u = observed(spark, sf).select((F.col("t") * 400 + F.col("i") * 20 + F.col("j")).alias("sample_id"), *names).unpivot(["sample_id"], names, "feature", "v")
    a = u.join(u.groupBy("feature").agg(F.avg("v").alias("m")), "feature").select(F.lit("a").alias("model"), "sample_id", "feature", "v", ((F.col("v") - F.col("m")) / 100).alias("phi"))
    return a.unionByName(a.withColumn("model", F.lit("b")).withColumn("phi", F.col("phi") * F.col("phi")))


@book.add("xai03_importance", sql(rounded_sql("SELECT model, feature, m AS mean_abs, row_number() OVER (PARTITION BY model ORDER BY m DESC, feature) AS rank FROM (SELECT model, feature, avg(abs(phi)) AS m FROM ph GROUP BY 1, 2)", "mean_abs", "model feature rank"), PHI))
def importance(spark, sf):
    return rounded(attribute.importance(phi(spark, sf)))


@book.add("xai04_agreement", sql(rounded_sql("SELECT corr(a, b) AS agreement FROM (SELECT feature, avg(CASE WHEN model='a' THEN abs(phi) END) AS a, avg(CASE WHEN model='b' THEN abs(phi) END) AS b FROM ph GROUP BY feature)", "agreement"), PHI))
def agreement(spark, sf):
    x = attribute.importance(phi(spark, sf)).groupBy("feature").pivot("model", ["a", "b"]).agg(F.first("mean_abs"))
    return rounded(x.agg(F.corr("a", "b").alias("agreement")))


@book.add("xai05_groups", sql(rounded_sql("SELECT model, g AS name, avg(s) AS importance FROM (SELECT model, g, sample_id, sum(abs(phi)) AS s FROM (SELECT *, CASE WHEN feature IN ('pr', 'chirps') THEN 'Water' WHEN feature LIKE 'tm%' THEN 'Heat' ELSE 'Other' END AS g FROM ph) GROUP BY 1, 2, 3) GROUP BY 1, 2", "importance", "model name"), PHI))
def groups(spark, sf):
    return rounded(attribute.group_importance(phi(spark, sf), {"Water": "^(pr|chirps)", "Heat": "^tm"}).withColumnRenamed("group", "name"))


@book.add("xai06_reconstruction", sql(rounded_sql("SELECT model, avg(s) AS mean_sum, max(abs(s)) AS largest FROM (SELECT model, sample_id, sum(phi) AS s FROM ph GROUP BY 1, 2) GROUP BY model", "mean_sum largest", "model"), PHI))
def reconstruction(spark, sf):
    return rounded(phi(spark, sf).groupBy("model", "sample_id").agg(F.sum("phi").alias("s")).groupBy("model").agg(F.avg("s").alias("mean_sum"), F.max(F.abs("s")).alias("largest")))


@book.add("xai07_dependence", sql(rounded_sql("SELECT model, sample_id, feature, v, phi FROM ph WHERE feature = 'pr'", "v phi", "model sample_id feature"), PHI))
def dependence(spark, sf):
    return rounded(phi(spark, sf).where("feature = 'pr'"))


@book.add("agg35_attribution_audit", sql(rounded_sql("SELECT model, min(phi) AS min, max(phi) AS max, avg(phi) AS mean, stddev_pop(phi) AS std, quantile_cont(phi, 0.5) AS median, avg(abs(phi)) AS abs_mean, count(*) FILTER (WHERE abs(phi) > 1000) AS above_1000, count(*) FILTER (WHERE abs(phi) > 10000) AS above_10000 FROM ph WHERE feature = 'pr' GROUP BY model", "min max mean std median abs_mean", "model above_1000 above_10000"), PHI))
def attribution_audit(spark, sf):
    x = phi(spark, sf).where("feature = 'pr'")
    return rounded(x.groupBy("model").agg(F.min("phi").alias("min"), F.max("phi").alias("max"), F.avg("phi").alias("mean"), F.stddev_pop("phi").alias("std"), F.percentile("phi", 0.5).alias("median"), F.avg(F.abs("phi")).alias("abs_mean"), F.count_if(F.abs("phi") > 1000).alias("above_1000"), F.count_if(F.abs("phi") > 10000).alias("above_10000")))


@book.add("srt01_top_features", sql("SELECT model, feature FROM (SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY avg(abs(phi)) DESC, feature) AS r FROM ph GROUP BY 1, 2) WHERE r <= 2", PHI))
def top_features(spark, sf):
    return attribute.importance(phi(spark, sf)).where("rank <= 2").select("model", "feature")


@book.add("set06_top_union", sql("SELECT DISTINCT feature FROM (SELECT feature, row_number() OVER (PARTITION BY model ORDER BY avg(abs(phi)) DESC, feature) AS r FROM ph GROUP BY model, feature) WHERE r <= 2", PHI))
def top_union(spark, sf):
    return top_features(spark, sf).select("feature").distinct()


@book.add("set07_holdout", sql("SELECT t, i, j FROM fine WHERE NOT ('0x' || substr(md5(concat_ws('-', t, i, j, '42')), 1, 8))::BIGINT < CAST(0.7*4294967296 AS BIGINT)"))
def holdout(spark, sf):
    x = observed(spark, sf).select("t", "i", "j")
    return x.where(~train.hash_split(x, ["t", "i", "j"], 0.7))


@book.add("ml03_network")
def network(spark, sf):
    """A small network and a linear epsilon-insensitive fit on the hash split, by distributed gradients."""
    x = training(spark, sf)
    x = x.withColumn("_train", train.hash_split(x, ["t", "i", "j"], 0.7)).select(*FEATURES, "y", "_train").cache()
    out = None
    for name, model, rounds in (("nn", Network(FEATURES), 20), ("svr", svr(FEATURES), 20)):
        told = model.fit(x.where("_train"), rounds=rounds, rate=0.08).transform(x.where("not _train"))
        m = regression(told, "y", "prediction", []).select(F.lit(name).alias("model"), "n", "r2", "rmse", "mae")
        out = m if out is None else out.unionByName(m)
    return out


@book.add("ml16_trial_objective")
def trial_objective(spark, sf):
    """Trials with their objective, rejected where the fit is poor; the best first."""
    value = study.simple_objective(F.col("r2"), F.lit(0.0))
    return search(spark, sf).withColumn("objective", value).orderBy(F.desc("objective"), "trial")


def _coarse_signal(spark, sf):
    return coarsen(signal(spark, sf), FACTOR, {"value": "mean"}, SIDE, SIDE).withColumnsRenamed({"ci": "i", "cj": "j"})


def _job(spark, sf, **settings):
    """All steps of the job over the grid tables, in a store of its own."""
    import uuid

    from ..sources.scratch import shared_folder
    from . import steps

    job = steps.Job(spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", _coarse_signal(spark, sf), signal(spark, sf).drop("value"), static(spark, sf), settings=steps.Settings(**settings), trials=0)
    steps.run(job, [s for s in steps.STEPS if s != "bake_off"])
    return job


@book.add("pipe_downscale")
def pipe_downscale(spark, sf):
    return _job(spark, sf).read("product")


@book.add("pipe_validate")
def pipe_validate(spark, sf):
    return _job(spark, sf, method="bilinear").read("metrics")
