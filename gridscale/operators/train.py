"""Models on the coarse grid: registry, blocked and simple validation, ensembles and search."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boost import FAMILIES, Booster
from .metrics import regression


#: Families, and the parameters each starts from.
DEFAULTS = {
    "rf": {"numTrees": 20, "maxDepth": 6},
    "gbr": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2},
    "xgb": {"rounds": 10, "depth": 4, "rate": 0.3},
    "lgb": {"rounds": 10, "leaves": 15, "rate": 0.3},
    "catb": {"rounds": 10, "depth": 4, "rate": 0.3},
    "linear": {"regParam": 0.01},
    "nn": {"hidden": (16, 8), "rounds": 20, "rate": 0.08},
    "svr": {"fourier": 128, "rounds": 20, "rate": 0.08},
}


def regressor(name: str, **params):
    """One of Spark's own estimators by family name."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    kinds = {"rf": RandomForestRegressor, "gbr": GBTRegressor, "linear": LinearRegression}
    if name not in kinds:
        raise ValueError(f"no model named {name}")
    seed = {} if name == "linear" else {"seed": 42}
    return kinds[name](featuresCol="features", labelCol="y", predictionCol="prediction", **seed, **{**DEFAULTS[name], **params})


class Descent:
    """A network or an epsilon-insensitive fit as an estimator; it scales its features itself."""

    def __init__(self, name: str, features: list[str], rounds: int, rate: float, **shape):
        self.name, self.features, self.rounds, self.rate, self.shape = name, features, rounds, rate, shape

    def fit(self, table: DataFrame):
        from .gradient import Network, svr

        model = Network(self.features, **self.shape) if self.name == "nn" else svr(self.features, **self.shape)
        return model.fit(table, rounds=self.rounds, rate=self.rate)


def pipeline(name: str, features: list[str], scaling: str | None = None, **params):
    """Rows with a missing feature are skipped. ``scaling`` is robust (median and quartiles, the linear model's own),
    standard (mean and deviation) or None; networks and epsilon-insensitive fits scale by themselves, and the boosters of
    this library (xgb, lgb, catb) need none."""
    if name in FAMILIES:
        return Booster(features, name, **{**DEFAULTS[name], **params})
    if name in ("nn", "svr"):
        return Descent(name, features, **{**DEFAULTS[name], **params})
    scaling = scaling or ("robust" if name == "linear" else None)
    if scaling is None:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), regressor(name, **params)])
    scaler = RobustScaler(inputCol="raw", outputCol="features", withCentering=True) if scaling == "robust" else StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), scaler, regressor(name, **params)])


def trained(table: DataFrame, features: list[str], models: list[str], tuned: dict[str, dict] | None = None, scaling: str | None = None) -> tuple[dict, dict[str, str]]:
    """Fitted models by name, with tuned parameters where there are some, and what went wrong with those that failed."""
    done, failed = {}, {}
    for name in models:
        try:
            done[name] = pipeline(name, features, scaling, **(tuned or {}).get(name, {})).fit(table)
        except Exception as e:  # one model that cannot be fitted must not stop the others
            failed[name] = str(e).split("\n")[0]
    return done, failed


def hash_split(df: DataFrame, keys: list[str], share: float, seed: int = 42) -> Column:
    """A repeatable train flag: the first eight hex digits of a hash of the keys, below ``share`` of their range."""
    digest = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * 16**8)


def simple_validation(table: DataFrame, features: list[str], models: list[str], keys: list[str], share: float = 0.7, tuned: dict[str, dict] | None = None) -> DataFrame:
    """Test metrics of each model after one repeatable split, and its r2 on the training rows; models that cannot be
    fitted are left out. ``tuned`` has parameters by model."""
    x = table.withColumn("_train", hash_split(table, keys, share))
    done, _ = trained(x.where("_train"), features, models, tuned)
    out = []
    for name, model in done.items():
        own = regression(model.transform(x.where("_train")), "y", "prediction", []).select(F.col("r2").alias("train_r2"))
        test = regression(model.transform(x.where("not _train")), "y", "prediction", [])
        out.append(test.crossJoin(F.broadcast(own)).withColumn("model", F.lit(name)))  # a row each
    if not out:
        return table.sparkSession.createDataFrame([], "n long, r2 double, rmse double, mae double, bias double, r double, slope double, intercept double, train_r2 double, model string")
    return reduce(DataFrame.unionByName, out)


def blocked_validation(with_roles: DataFrame, features: list[str], models: list[str], tuned: dict[str, dict] | None = None, workers: int = 4) -> DataFrame:
    """Metrics by model and fold of a table with ``fold`` and ``role``; a fold without rows on a side is skipped, and so
    is a model that cannot be fitted on it. Up to ``workers`` fits run at a time, each a set of Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    sizes = with_roles.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")).orderBy("fold").collect()

    def one(task: tuple) -> list[tuple]:
        name, s = task
        own = with_roles.where(F.col("fold") == s.fold)
        done, _ = trained(own.where("role = 'train'"), features, [name], tuned)
        if not done:
            return []
        m = regression(done[name].transform(own.where("role = 'test'")), "y", "prediction", []).first()
        return [(name, s.fold, s.n_train, s.n_test, m.r2, m.rmse, m.mae)]

    tasks = [(name, s) for s in sizes if s.n_train and s.n_test for name in models]
    with ThreadPoolExecutor(workers) as pool:
        rows = [r for got in pool.map(one, tasks) for r in got]  # a row for each fold and model
    return with_roles.sparkSession.createDataFrame(rows, "model string, fold int, n_train long, n_test long, r2 double, rmse double, mae double")


def weights(summary: DataFrame, score: str, inverse: bool = False, floor: float = 0.05) -> DataFrame:
    """Ensemble weights by score, or by its inverse, with a floor, adding up to 1; a row for each model."""
    v = 1 / F.col(score) if inverse else F.col(score)
    everything = Window.partitionBy()
    x = summary.withColumn("_w", F.greatest(v / F.sum(v).over(everything), F.lit(floor)))
    return x.withColumn("weight", F.col("_w") / F.sum("_w").over(everything)).drop("_w")


def ensemble(weight: dict[str, float]) -> Column:
    """Weighted mean of prediction columns; null if one is null."""
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weight.items()]) / sum(weight.values())


def mean_of(columns: list[str]) -> Column:
    """Mean of the columns that are not null."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
