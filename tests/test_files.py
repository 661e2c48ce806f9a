import numpy as np
from pyspark.sql import functions as F

from gridscale.operators import train
from gridscale.operators.gradient import Network, svr
from gridscale.sources.files import cv_results, load_models, month_of_name, resolve, save_grid, save_metrics, save_models, scale_or_one, with_month


def test_month_of_name(spark):
    names = {"201503.parquet": 26, "/a/b/201301.tif": 0, "17.tif": 17, "201313.tif": None, "notes.txt": None, "12345678.tif": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", month_of_name(F.col("n"), 2013).alias("t")).collect()} == names


def test_monthly_files_and_sinks(spark, tmp_path):
    for m in ("201301", "201303", "readme"):
        spark.range(3).coalesce(1).toPandas().to_parquet(tmp_path / f"{m}.parquet")
    x = with_month(spark.read.parquet(str(tmp_path / "*.parquet")), 2013)
    assert {r.t: r["count"] for r in x.groupBy("t").count().collect()} == {0: 3, 2: 3}
    df = spark.createDataFrame([(0, 1, 1, 2.5), (13, 1, 1, 3.5)], "t int, i int, j int, value double")
    save_grid(df, str(tmp_path / "grid"), "a title", "fill", 1995)
    back = spark.read.parquet(str(tmp_path / "grid"))
    assert {r.year for r in back.collect()} == {1995, 1996} and dict(back.dtypes)["value"] == "float" and back.schema["value"].metadata["title"] == "a title"
    save_metrics(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    (tmp_path / "rf_cv_results.csv").write_text("fold,n_train,n_test,r2,rmse,mae\n1,10,5,0.5,1,1\n")
    assert cv_results(spark, str(tmp_path / "*_cv_results.csv")).first().model == "rf"


def test_scale_and_columns(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0), (0, 1)], "i int, j int")
    assert all(r.scale_factor == 1.0 and not r.scaled for r in scale_or_one(spark, str(tmp_path / "none"), cells).collect())
    spark.createDataFrame([(0, 0, 2.0)], "i int, j int, scale_factor double").write.parquet(str(tmp_path / "s"))
    assert sorted((r.scale_factor, r.scaled) for r in scale_or_one(spark, str(tmp_path / "s"), cells).collect()) == [(1.0, False), (2.0, True)]
    assert resolve(["a", "TWS"], ["lwe", "TWS"]) == "TWS"


def test_models_round_trip_and_gradients(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=300), rng.normal(size=300)
    x = spark.createDataFrame([(float(p), float(q), float(3 * p - q + 1)) for p, q in zip(a, b)], "a double, b double, y double")
    model = train.pipeline("linear", ["a", "b"]).fit(x)
    save_models({"linear": model}, str(tmp_path), spark.createDataFrame([("linear", 1.0)], "model string, weight double"))
    models, weights = load_models(spark, str(tmp_path), ["linear"])
    assert weights == {"linear": 1.0} and abs(models["linear"].transform(x).first().prediction - model.transform(x).first().prediction) < 1e-9
    net = Network(["a", "b"], (4,))
    w, h = net.weights, 1e-6
    xs, ys = np.c_[a, b][:20], (3 * a - b)[:20]
    g, _ = net._gradient(w, xs, ys)
    step = lambda k: np.where(np.arange(len(w)) == k, h, 0)
    near = [(net._gradient(w + step(k), xs, ys)[1] - net._gradient(w - step(k), xs, ys)[1]) / (2 * h) for k in range(len(w))]
    assert np.allclose(g, near, atol=1e-3)
    told = svr(["a", "b"]).fit(x, rounds=25, rate=0.1).transform(x).toPandas()
    assert np.corrcoef(told.y, told.prediction)[0, 1] > 0.97
