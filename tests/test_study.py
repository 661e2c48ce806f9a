import pytest
from pyspark.sql import functions as F

from gridscale.operators import grid, study, train
from gridscale.sources.files import catalogue, load_attributions, load_models, load_tuned, monthly_cells, months_stored, save_attributions, save_cv, save_models, save_run_info, save_tuned, with_tuned


def test_spaces_are_drawn_in_range_and_mapped(spark):
    trials = spark.createDataFrame([(m, k) for m in study.SPACES for k in range(40)], "model string, trial long")
    drawn = {}
    for r in study.sampled(trials).collect():
        drawn.setdefault((r.model, r.trial), {})[r.param] = r.choice if r.choice is not None else r.number
    for (model, _), params in drawn.items():
        for p in study.SPACES[model]:
            if p[0] in params:
                assert params[p[0]] in p[2] if p[1] == "choice" else p[2] - 1e-12 <= params[p[0]] <= p[3] + 1e-12
        assert ("drop_rate" in params) == (params.get("boosting_type") == "dart") and ("top_rate" in params) == (params.get("boosting_type") == "goss")
        train.pipeline(model, ["a"], **study.mapped(model, params, 5, 4))
    trees = {m: {study.mapped(m, p, 20, 6)[k] for (n, _), p in drawn.items() if n == m} for m, k in (("rf", "numTrees"), ("xgb", "rounds"), ("lgb", "leaves"))}
    assert all(len(v) > 5 for v in trees.values())
    assert {len([p for p in space if len(p) < 5]) for space in study.SPACES.values()} == {13, 8, 15}
    assert study.n_trials("rf", 3) == 4 and study.n_trials("xgb", 3) == 3


def test_objectives(spark):
    rows = [(0.9, 0.0), (0.9, 900.0), (0.9, 7000.0), (0.4, 1.0), (0.6, 4000.0), (0.7, 6600.0), (0.9, 11000.0), (None, 1.0)]
    got = [r.v for r in spark.createDataFrame(rows, "r2 double, s double").select(study.simple_objective(F.col("r2"), F.col("s")).alias("v")).collect()]
    assert got == pytest.approx([0.9, 0.875, 0.875, -999, -999, -999, -999, -999])
    assert spark.range(1).select(study.blocked_objective(F.lit(0.5), F.lit(3600.0)).alias("v")).first().v == pytest.approx(0.475)


def test_tuned_parameters_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("rf", 1, 0.5, {"max_depth": "3"}), ("rf", 2, 0.7, {"max_depth": "5"}), ("rf", 3, 0.7, {"max_depth": "9"})], "model string, trial long, value double, params map<string,string>")
    save_tuned(study.best_parameters(log, ["model"]), str(tmp_path / "tuned"))
    assert load_tuned(spark, str(tmp_path / "tuned")) == {"rf": {"max_depth": "5"}} and load_tuned(spark, str(tmp_path / "none")) == {} and load_tuned(spark, None) == {}
    assert with_tuned({"rf": {"a": 1, "b": 2}}, {"rf": {"b": 3}, "x": {"c": 4}}) == {"rf": {"a": 1, "b": 3}, "x": {"c": 4}}


def test_failing_models_are_skipped(spark):
    table = spark.createDataFrame([(float(k), 2.0 * k) for k in range(30)], "a double, y double")
    done, failed = train.trained(table, ["a"], ["linear", "no_such"])
    assert list(done) == ["linear"] and list(failed) == ["no_such"]
    folds = table.withColumn("fold", F.lit(1)).withColumn("role", F.when(F.col("a") < 20, "train").otherwise("test"))
    got = train.blocked_validation(folds, ["a"], ["linear", "no_such"]).collect()
    assert [(r.model, r.n_train, r.n_test) for r in got] == [("linear", 20, 10)] and got[0].r2 > 0.99


def test_names_catalogues_and_marks(spark, tmp_path):
    assert grid.matched(["sand_0cm", "elevation"], ["soil_sand_0cm", "elevation", "soil_x"]) == {"soil_sand_0cm": "sand_0cm", "elevation": "elevation"}
    with pytest.raises(ValueError):
        grid.base_subset(spark.range(1), ["id", "absent"], [])
    assert grid.aggregation_factor(0.5, 0.05) == 10
    files = spark.createDataFrame([("s", "v", "199502.tif"), ("s", "v", "notes.txt")], "source string, variable string, file string")
    got = {r.t: r.file for r in catalogue(files, spark.range(3).select(F.col("id").cast("int").alias("t")), 1995).collect()}
    assert got == {0: None, 1: "199502.tif", 2: None}
    spark.range(10).select(F.col("id").alias("t")).write.parquet(str(tmp_path / "months"))
    assert months_stored(spark, str(tmp_path / "months"), 10) and not months_stored(spark, str(tmp_path / "months"), 12) and not months_stored(spark, str(tmp_path / "no"), 1)
    save_run_info(spark, str(tmp_path / "info"), "a", "b", 7)
    assert spark.read.parquet(str(tmp_path / "info")).first().seed == 7
    save_cv(spark.createDataFrame([("rf", 1, 0.5), ("linear", 1, 0.4)], "model string, fold int, r2 double"), str(tmp_path / "cv"))
    assert spark.read.csv(str(tmp_path / "cv"), header=True).count() == 2
    axes = grid.axes(None, spark, 3, 2, 4, (0.0, 1.0, 10.0, 20.0))
    assert axes.count() == 24 and {r.lat for r in axes.collect()} == {0.0, 0.5, 1.0}


def small_job(spark, store, models=("linear",), trials=0, **settings):
    from gridscale.plans import steps

    fine = spark.range(12 * 20 * 20).select((F.col("id") % 12).cast("int").alias("t"), (F.floor(F.col("id") / 12) % 20).cast("int").alias("i"), F.floor(F.col("id") / 240).cast("int").alias("j"))
    fine = fine.withColumns({c: F.pmod(F.xxhash64("t", "i", "j", F.lit(c)), F.lit(1000)) / 10.0 for c in ("pr", "tmmn", "tmmx", "aet")}).withColumn("value", F.col("pr") + F.col("i"))
    signal = fine.groupBy("t", F.floor(F.col("i") / 5).cast("int").alias("i"), F.floor(F.col("j") / 5).cast("int").alias("j")).agg(F.avg("value").alias("value")).where("t <> 5")
    static = fine.select("i", "j").distinct().withColumn("elevation", F.col("i") * 1.0).withColumn("population", F.col("j") * 1.0)
    return steps.Job(spark, str(store), signal, fine.drop("value"), static, settings=steps.Settings(base=("pr", "aet", "tmean"), rain=(), **settings), models=models, trials=trials)


def test_steps_are_stored_and_used_again(spark, tmp_path):
    from gridscale.plans import steps

    job = small_job(spark, tmp_path)
    steps.gap_fill(job), steps.create_features(job)
    first = job.read("filled")
    assert first.count() == 12 * 16 and first.where("t = 5 and observed is null").count() == 16
    done = job.read("run_info").count()
    steps.gap_fill(job)
    steps.create_features(job)
    assert job.read("run_info").count() == done  # nothing has changed
    job.signal = job.signal.withColumn("value", 100 * F.col("value"))
    steps.gap_fill(job)
    again = job.read("filled").agg(F.avg("observed")).first()[0]
    assert job.read("run_info").count() == done + 1 and again == pytest.approx(job.signal.agg(F.avg("value")).first()[0])
    job.settings.base = ("pr", "tmean")
    steps.create_features(job)
    assert "aet" not in job.read("fine").columns


def test_only_changed_months_are_rewritten(spark, tmp_path):
    from gridscale.sources.files import fingerprint, is_current, save_months

    path = str(tmp_path / "x")
    x = spark.range(60).select((F.col("id") % 6).cast("int").alias("t"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("value"))
    assert save_months(x, path, fingerprint(x)) == [0, 1, 2, 3, 4, 5] and is_current(spark, path, fingerprint(x.orderBy("value")))
    names = {f.parent.name: f.name for f in (tmp_path / "x").glob("t=*/*.parquet")}
    y = x.withColumn("value", F.when(F.col("i") == 13, -1.0).otherwise(F.col("value")))
    assert not is_current(spark, path, fingerprint(y)) and save_months(y, path, fingerprint(y)) == [1]
    now = {f.parent.name: f.name for f in (tmp_path / "x").glob("t=*/*.parquet")}
    assert {k for k in names if names[k] != now[k]} == {"t=1"} and spark.read.parquet(path).where("value = -1").count() == 1
    save_months(y.where("t <> 3"), path, "other")
    assert spark.read.parquet(path).select("t").distinct().count() == 5


def test_a_model_that_fails_does_not_stop_the_step_and_the_winner_is_read_back(spark, tmp_path):
    from gridscale.plans import steps

    job = small_job(spark, tmp_path, models=("linear", "unheard_of", "nn"))
    steps.run(job)
    assert {r.model for r in job.read("scores").collect()} == {"linear", "nn"} and job.read("scores").where("train_r2 is null").count() == 0
    assert job.read("product").count() > 0 and job.read("metrics").count() == 2
    scores = {r.method: round(r.r2, 9) for r in job.read("bake_off").collect()}
    best = min(scores, key=lambda m: (-scores[m], m))
    assert len(scores) == 8 and small_job(spark, tmp_path).method() == best and small_job(spark, tmp_path, method="idw").method() == "idw"
    job.signal = job.signal.withColumn("t", F.col("t") + 500)
    job.store = str(tmp_path / "none")
    steps.gap_fill(job), steps.create_features(job), steps.aggregate(job)
    with pytest.raises(ValueError, match="share no month"):
        steps._training(job)


def test_product_without_correction_is_the_prediction(spark, tmp_path):
    from gridscale.plans import steps
    from gridscale.plans.steps import Settings

    told = spark.createDataFrame([(0, 1, 1, 2.5)], "t int, i int, j int, predicted double")
    told.write.parquet(str(tmp_path / "fine_prediction"))
    job = steps.Job(spark, str(tmp_path), None, None, None, settings=Settings(correct=False))
    steps.correct(job)
    assert [tuple(r) for r in job.read("product").collect()] == [(0, 1, 1, 2.5, 0.0, 2.5)]


def test_monthly_files_models_and_attributions(spark, tmp_path):
    for m in ("199501", "199503", "readme"):
        spark.createDataFrame([(0, 0, 1.0, 5.0, float(len(m))), (1, 0, 9.0, 5.0, 2.0)], "i int, j int, lat double, lon double, value double").toPandas().to_parquet(tmp_path / f"{m}.parquet")
    got = monthly_cells(spark.read.parquet(str(tmp_path / "*.parquet")), 1995, (0, 2), (0.0, 2.0), (4.0, 6.0))
    assert sorted((r.t, r.i, r.value) for r in got.collect() if r.value is not None) == [(0, 0, 6.0), (2, 0, 6.0)] and got.count() == 3
    table = spark.createDataFrame([(float(k), 2.0 * k) for k in range(30)], "a double, y double")
    save_models({"linear": train.pipeline("linear", ["a"]).fit(table)}, str(tmp_path / "models"))
    models, weights = load_models(spark, str(tmp_path / "models"))
    assert list(models) == ["linear"] and weights == {}
    save_attributions(spark.createDataFrame([("a", "1", "x", 0.5, 0.1), ("b", "1", "x", 0.5, 0.2)], "model string, sample_id string, feature string, x double, phi double"), str(tmp_path / "phi"))
    assert [r.phi for r in load_attributions(spark, str(tmp_path / "phi"), ["b"]).collect()] == [0.2] and load_attributions(spark, str(tmp_path / "phi")).count() == 2
