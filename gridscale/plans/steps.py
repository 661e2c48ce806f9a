"""The job step by step: each step reads what earlier ones stored under a folder and stores its own result.

A stored step survives lost executors. Steps that make monthly tables keep a fingerprint of their inputs and settings and
are skipped while it is the same; when it changes they are done again, and of their table only the months that come out
different are rewritten. Any step can be run alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, series, study, train, weights
from ..operators.coarsen import coarsen
from ..operators.metrics import regression
from ..sources import files


@dataclass
class Settings:
    """``method`` is how coarse residuals reach the fine grid: None for the stored winner of the bake-off, if there is one."""

    factor: int = 5
    n_rows: int = 20
    n_columns: int = 20
    base: tuple[str, ...] = ("pr", "tmean", "aet")
    method: str | None = None
    smooth: bool = False
    correct: bool = True
    rain: tuple[str, ...] = ("pr",)
    static: tuple[str, ...] = ("elevation", "population")


def features(fine: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """Anomalies, lags and sums in one pass over each cell's series, then spatial means; and the names made."""
    x = fine.withColumn("tmean", (F.col("tmmn") + F.col("tmmx")) / 2).drop("tmmn", "tmmx")
    made = {f"{c}_anom": series.anomaly(c) for c in s.base} | {f"{c}_lag{k}": series.lagged(c, k) for c in s.base for k in (1, 3, 6)}
    made |= {f"{c}_accum{k}m": series.rolling_sum(c, k) for c in s.rain for k in (3, 6, 12)}
    x = x.select("t", "i", "j", *s.base, *[c.alias(n) for n, c in made.items()])
    names = [*s.base, *made]
    for c in s.base:
        x = series.spatial_mean(x, f"{c}_anom", f"{c}_anom_spatial")
        names.append(f"{c}_anom_spatial")
    return x, names


@dataclass
class Job:
    """Source tables, the folder of stored steps, and settings.

    ``signal`` (t, i, j, value) and ``fine`` (t, i, j, base features) have rows for months and cells that have data;
    ``static`` has one for each cell, ``scale`` a factor for each coarse cell or is None.
    """

    spark: SparkSession
    store: str
    signal: DataFrame
    fine: DataFrame
    static: DataFrame
    scale: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    models: tuple[str, ...] = ("rf", "linear")
    trials: int = 1
    most_trees: int = 8
    seed: int = 42

    def path(self, name: str) -> str:
        return f"{self.store}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str, step: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))
        files.save_run_info(self.spark, self.path("run_info"), name, step, self.seed)

    def has(self, name: str) -> bool:
        return files.exists(self.spark, self.path(name))

    def method(self) -> str:
        """The method set, else the winner of the stored bake-off, else geographic assignment."""
        if self.settings.method:
            return self.settings.method
        return winner(self.read("bake_off")) if self.has("bake_off") else "geographic"


def winner(scores: DataFrame) -> str:
    """The method of the best score; of scores equal to nine digits the first name."""
    return scores.agg(F.min_by("method", F.struct(-F.round("r2", 9), "method")).alias("m")).first()["m"]


def gap_fill(job: Job) -> None:
    """Signal on the month spine, times its factors, with its gaps filled; kept with what each cell's fill was like."""
    s = job.signal.select("t", "i", "j", "value")
    mark = files.fingerprint(s, *([job.scale] if job.scale is not None else []))
    if files.is_current(job.spark, job.path("filled"), mark):
        return
    if job.scale is not None:
        s = grid.scaled(s, job.scale, ["i", "j"]).select("t", "i", "j", "value")
    ends = s.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = s.select("i", "j").distinct().crossJoin(F.broadcast(ends.select(F.explode(F.sequence("a", "b")).alias("t"))))  # the month axis
    filled = series.stl_fill(spine.join(s, ["t", "i", "j"], "left").select("t", "i", "j", "value"))
    told = filled.select("t", "i", "j", F.col("value").alias("observed"), F.col("filled").alias("value"), "method", "values_filled", "test_r2", "test_rmse")
    files.save_months(told, job.path("filled"), mark)
    files.save_run_info(job.spark, job.path("run_info"), "filled", "gap_fill", job.seed)


def create_features(job: Job) -> None:
    """Fine features in one pass over each cell's series, with the static ones beside them."""
    s = job.settings
    mark = f"{files.fingerprint(job.fine, job.static)} {s.base} {s.rain} {s.static}"
    if files.is_current(job.spark, job.path("fine"), mark):
        return
    x, names = features(job.fine, s)
    x = x.join(job.static.select("i", "j", *s.static), ["i", "j"], "left")
    files.save_months(x.select("t", "i", "j", *names, *s.static), job.path("fine"), mark)
    files.save_run_info(job.spark, job.path("run_info"), "fine", "create_features", job.seed)


def _names(job: Job) -> list[str]:
    return [c for c in job.read("fine").columns if c not in ("t", "i", "j")]


def aggregate(job: Job) -> None:
    """Block means on the coarse grid, on the months of features and signal together; months without features are
    filled in and carried on by lines through each cell's series."""
    s, names = job.settings, _names(job)
    c = coarsen(job.read("fine"), s.factor, {n: "mean" for n in names}, s.n_rows, s.n_columns).withColumnsRenamed({"ci": "i", "cj": "j"})
    months = c.select("t").union(job.read("filled").select("t")).distinct()
    grid_rows = c.select("i", "j").distinct().crossJoin(F.broadcast(months)).join(c, ["t", "i", "j"], "left")  # the month axis
    for n in names:
        grid_rows = series.linear_fill(grid_rows, n, "_filled").drop(n).withColumnRenamed("_filled", n) if n in s.base else grid_rows
    job.write(grid_rows.select("t", "i", "j", *names), "coarse", "aggregate")


def _training(job: Job) -> DataFrame:
    y = job.read("filled").select("t", "i", "j", F.col("value").alias("y"))
    table = job.read("coarse").join(y, ["t", "i", "j"]).dropna(subset=["y", *_names(job)])
    if table.isEmpty():
        raise ValueError("features and signal share no month and cell")
    return table


def tune(job: Job) -> None:
    """Random search for the families that have a space; the trials and each family's best parameters are kept."""
    models = [m for m in job.models if m in study.SPACES]
    if not models or not job.trials:
        return
    log = study.run(_training(job), _names(job), ["t", "i", "j"], models, job.trials, most_trees=job.most_trees)
    job.write(log, "trials", "tune")
    best = study.best_parameters(job.read("trials").where("state = 'complete'").withColumn("study", F.col("model")), ["model"])
    files.save_tuned(best, job.path("tuned"))


def train_models(job: Job) -> None:
    """Scores on one repeatable split, final fits on all rows with the same parameters, ensemble weights; models that fail
    are left out."""
    names, table = _names(job), _training(job)
    tuned = {m: study.mapped(m, {k: _number(v) for k, v in p.items()}, job.most_trees, 6) for m, p in files.load_tuned(job.spark, job.path("tuned")).items()}
    scores = train.simple_validation(table, names, list(job.models), ["t", "i", "j"], tuned=tuned)
    job.write(scores, "scores", "train")
    done, failed = train.trained(table, names, list(job.models), tuned)
    if not done:
        raise ValueError(f"no model could be fitted: {failed}")
    summary = job.read("scores").where(F.col("model").isin(list(done))).withColumn("score", F.greatest("r2", F.lit(1e-6)))
    files.save_models(done, job.path("models"), train.weights(summary, "score"))


def _number(v: str):
    try:
        return float(v)
    except ValueError:
        return v


def predict(job: Job) -> None:
    """The ensemble on both grids, month by month of the features."""
    names = _names(job)
    fitted, weight = files.load_models(job.spark, job.path("models"))
    fitted = {m: model for m, model in fitted.items() if m in weight}

    def told(df: DataFrame) -> DataFrame:
        for m, model in fitted.items():
            df = model.transform(df).withColumnRenamed("prediction", f"prediction_{m}").drop("features", "raw")
        total = train.ensemble({f"prediction_{m}": w for m, w in weight.items()}) if weight else train.mean_of([f"prediction_{m}" for m in fitted])
        return df.select("t", "i", "j", *[f"prediction_{m}" for m in fitted], total.alias("predicted"))

    job.write(told(job.read("fine").dropna(subset=names)), "fine_prediction", "predict")
    job.write(told(_training(job)), "coarse_prediction", "predict")


def _tables(job: Job, cells: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
    """Weight tables of all methods that can be made, or of one."""
    s = job.settings
    n, m = s.n_rows // s.factor, s.n_columns // s.factor
    half = (s.factor - 1) / 2
    centres = job.read("coarse").select(F.col("i").alias("ci"), F.col("j").alias("cj")).distinct().withColumn("x", s.factor * F.col("ci") + half).withColumn("y", s.factor * F.col("cj") + half)
    bilinear, radius = weights.bilinear(cells, s.factor, n, m), 1.2 * s.factor
    make = {
        "area": lambda: weights.overlap(cells, float(s.factor), n, m), "bicubic": lambda: weights.cubic(cells, s.factor, n, m), "bilinear": lambda: bilinear, "distance": lambda: weights.within(cells, centres, radius),
        "gaussian": lambda: weights.smoothed(bilinear, cells, s.n_rows, s.n_columns), "geographic": lambda: weights.containing(cells, s.factor, n, m), "idw": lambda: weights.within(cells, centres, radius, 2.0),
        "nearest": lambda: weights.nearest(cells, s.factor, n, m),
    }
    out = {}
    for name, f in make.items():
        if only is None or name == only:
            try:
                out[name] = f()
            except (ValueError, AnalysisException):  # a method that doesn't suit the grid must not stop the others
                if name == only:
                    raise
    return out


def _residual(job: Job) -> DataFrame:
    y = job.read("filled").select("t", "i", "j", "value")
    r = job.read("coarse_prediction").join(y, ["t", "i", "j"]).select("t", "i", "j", (F.col("value") - F.col("predicted")).alias("residual"))
    s = job.settings
    if s.smooth:
        r = weights.gaussian(r, "residual", "residual", s.n_rows // s.factor, s.n_columns // s.factor)
    return grid.clip_spread(r, "residual", 3.0)


def correct(job: Job) -> None:
    """The coarse residual, smoothed if wanted and clipped at three deviations, carried down by the method set, and
    added; without correction the prediction is the product."""
    s, told = job.settings, job.read("fine_prediction").select("t", "i", "j", "predicted")
    if s.correct:
        job.write(_residual(job), "residual", "correct")
        r = job.read("residual").withColumnsRenamed({"i": "ci", "j": "cj"})
        method = job.method()
        table = _tables(job, told.select("i", "j").distinct(), method)[method]
        told = told.join(weights.apply(table, r, "residual", "correction"), ["t", "i", "j"])
    else:
        told = told.withColumn("correction", F.lit(0.0))
    told = told.select("t", "i", "j", F.col("predicted").alias("predicted_uncorrected"), F.col("correction").alias("residual_correction"), (F.col("predicted") + F.col("correction")).alias("downscaled"))
    job.write(told, "product", "correct")


def _against_signal(job: Job, product: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    s = job.settings
    back = coarsen(product, s.factor, {c: "mean" for c in columns}, s.n_rows, s.n_columns, (*by, "t")).withColumnsRenamed({"ci": "i", "cj": "j"})
    return back.join(job.read("filled").select("t", "i", "j", "value"), ["t", "i", "j"]).dropna(subset=[*columns, "value"])


def validate(job: Job) -> None:
    """Metrics of the product's block means against the signal, before and after correction."""
    x = _against_signal(job, job.read("product"), ["predicted_uncorrected", "downscaled"], [])
    both = [regression(x, "value", c, []).withColumn("stage", F.lit(n)) for c, n in (("predicted_uncorrected", "before"), ("downscaled", "after"))]
    job.write(both[0].unionByName(both[1]), "metrics", "validate")


def bake_off(job: Job) -> None:
    """Scores of all methods, which are stored; later runs on the same store correct by the winner."""
    told = job.read("fine_prediction").select("t", "i", "j", "predicted")
    r = _residual(job).withColumnsRenamed({"i": "ci", "j": "cj"})
    every = weights.apply_all(_tables(job, told.select("i", "j").distinct()), r, "residual", "correction")
    x = told.join(every, ["t", "i", "j"]).withColumn("downscaled", F.col("predicted") + F.col("correction"))
    scores = regression(_against_signal(job, x, ["downscaled"], ["method"]), "value", "downscaled", ["method"])
    job.write(scores, "bake_off", "bake_off")


STEPS: dict[str, Callable[[Job], None]] = {
    "gap_fill": gap_fill, "create_features": create_features, "aggregate": aggregate, "tune": tune, "train": train_models, "predict": predict, "bake_off": bake_off, "correct": correct, "validate": validate,
}


def run(job: Job, steps: list[str] | None = None) -> DataFrame:
    """Runs the steps named, or all, in their order; a validation that fails does not stop the job. Returns the product."""
    for name in steps or list(STEPS):
        try:
            STEPS[name](job)
        except (AnalysisException, ValueError):
            if name != "validate":
                raise
    return job.read("product")
