"""Parameter studies: search spaces as tables, objectives as columns, and random search over mapped estimators."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import train
from .metrics import regression

#: The parameters that are searched, with their kind and range; the last two groups of lgb belong to one boosting type.
SPACES = {
    "xgb": [
        ("n_estimators", "int", 50, 2000), ("max_depth", "int", 3, 15), ("learning_rate", "log", 0.005, 0.3), ("subsample", "float", 0.6, 1.0), ("colsample_bytree", "float", 0.6, 1.0),
        ("colsample_bylevel", "float", 0.6, 1.0), ("reg_alpha", "log", 1e-8, 100), ("reg_lambda", "log", 1e-8, 100), ("min_child_weight", "int", 1, 100), ("gamma", "float", 0, 10),
        ("max_delta_step", "int", 0, 10), ("scale_pos_weight", "float", 0.1, 10), ("grow_policy", "choice", ["depthwise", "lossguide"]),
    ],
    "rf": [
        ("max_features", "choice", ["sqrt", "log2"]), ("n_estimators", "int", 1000, 5000), ("max_depth", "int", 25, 80), ("min_samples_split", "int", 2, 50), ("min_samples_leaf", "int", 1, 15),
        ("max_samples", "float", 0.7, 0.9), ("min_impurity_decrease", "float", 0.001, 0.01), ("oob_score", "choice", ["true", "false"]),
    ],
    "lgb": [
        ("boosting_type", "choice", ["gbdt", "dart", "goss"]), ("n_estimators", "int", 50, 3000), ("max_depth", "int", -1, 20), ("num_leaves", "int", 10, 500), ("learning_rate", "log", 0.005, 0.3),
        ("feature_fraction", "float", 0.4, 1.0), ("bagging_fraction", "float", 0.4, 1.0), ("bagging_freq", "int", 1, 10), ("min_child_samples", "int", 1, 200), ("min_child_weight", "log", 1e-3, 10),
        ("reg_alpha", "log", 1e-8, 100), ("reg_lambda", "log", 1e-8, 100), ("min_split_gain", "float", 0, 1), ("subsample", "float", 0.4, 1.0), ("subsample_freq", "int", 1, 10),
        ("drop_rate", "float", 0.01, 0.8, "dart"), ("max_drop", "int", 1, 50, "dart"), ("skip_drop", "float", 0.0, 1.0, "dart"), ("top_rate", "float", 0.1, 1.0, "goss"), ("other_rate", "float", 0.01, 0.5, "goss"),
    ],
}
#: Objective of a trial that failed or was rejected.
FAILED = -999.0


def uniform(*parts) -> Column:
    """A repeatable number from 0 to 1 (exclusive) for the parts: the first eight hex digits of their hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def sampled(trials: DataFrame, seed: str = "42") -> DataFrame:
    """(model, trial, param, number, choice): a value of each parameter of the model's space for each trial (model, trial)."""
    spec = [(m, p[0], p[1], *((None, None, list(p[2])) if p[1] == "choice" else (float(p[2]), float(p[3]), None)), p[4] if len(p) > 4 else None) for m, space in SPACES.items() for p in space]
    table = trials.sparkSession.createDataFrame(spec, "model string, param string, kind string, lo double, hi double, choices array<string>, only string")
    x = trials.join(F.broadcast(table), "model")  # some forty rows
    u = uniform(F.col("model"), F.col("trial"), F.col("param"), seed)
    boost = F.get(F.array(*map(F.lit, SPACES["lgb"][0][2])), F.floor(uniform(F.col("model"), F.col("trial"), "boosting_type", seed) * 3).cast("int"))
    whole = F.floor(F.col("lo") + u * (F.col("hi") - F.col("lo") + 1)).cast("double")
    number = F.when(F.col("kind") == "int", whole).when(F.col("kind") == "log", F.exp(F.log("lo") + u * (F.log("hi") - F.log("lo")))).when(F.col("kind") == "float", F.col("lo") + u * (F.col("hi") - F.col("lo")))
    choice = F.get("choices", F.floor(u * F.size("choices")).cast("int"))
    return x.where(F.col("only").isNull() | (F.col("only") == boost)).select("model", "trial", "param", number.alias("number"), F.when(F.col("kind") == "choice", choice).alias("choice"))


def n_trials(model: str, n: int) -> int:
    """Trials of a model's study: a forest gets half as many again."""
    return int(n * 1.5) if model == "rf" else n


def mapped(model: str, params: dict, most_trees: int, most_depth: int) -> dict:
    """Parameters of the estimator for those of a trial. Numbers of trees, leaves and levels are scaled from the space's
    range to what the cluster is given for (``most_trees``, ``most_depth``), so that different trials stay different."""
    top = {p[0]: p[3] for p in SPACES[model] if p[1] in ("int", "float", "log")}
    number = lambda name, otherwise=None: params.get(name) if params.get(name) is not None else otherwise
    scaled = lambda name, most: max(1, round(float(params[name]) * most / top[name]))
    if model == "rf":
        out = {"numTrees": scaled("n_estimators", most_trees), "maxDepth": min(scaled("max_depth", most_depth), 30), "minInstancesPerNode": max(int(number("min_samples_leaf", 1)), int(number("min_samples_split", 2)) // 2)}
        out |= {"minInfoGain": float(number("min_impurity_decrease", 0.0)), "subsamplingRate": float(number("max_samples", 1.0)), "featureSubsetStrategy": number("max_features", "auto")}
        return out
    out = {"rounds": scaled("n_estimators", most_trees), "rate": float(params["learning_rate"]) * top["n_estimators"] / most_trees * 0.05, "l1": float(params["reg_alpha"]), "l2": float(params["reg_lambda"]), "least_weight": float(params["min_child_weight"])}
    out["rate"] = min(out["rate"], 0.5)
    if model == "xgb":
        out |= {"depth": scaled("max_depth", most_depth), "sample": "rows", "rows": float(params["subsample"]), "columns": float(params["colsample_bytree"]) * float(params["colsample_bylevel"]), "least_gain": float(params["gamma"]), "most_step": float(params["max_delta_step"])}
        out |= {"grow": "leafwise", "leaves": 1 << out["depth"]} if params["grow_policy"] == "lossguide" else {"grow": "depthwise"}
        return out
    out |= {"leaves": max(2, scaled("num_leaves", 1 << most_depth)), "depth": 0 if int(params["max_depth"]) <= 0 else scaled("max_depth", most_depth), "columns": float(params["feature_fraction"]), "least_rows": int(params["min_child_samples"]), "least_gain": float(params["min_split_gain"])}
    kind = params["boosting_type"]
    if kind == "goss":
        out |= {"sample": "goss", "top": float(params["top_rate"]), "other": float(params["other_rate"])}
    else:
        out |= {"sample": "rows", "rows": float(params["bagging_fraction"])}
    if kind == "dart":
        out |= {"drop": float(params["drop_rate"]), "most_drop": int(params["max_drop"]), "skip_drop": float(params["skip_drop"])}
    return out


def simple_objective(r2: Column, seconds: Column, limit: float = 10800.0) -> Column:
    """r2 less a small price of time; poor, slow and mediocre, and overlong trials fail."""
    bad = (r2 < 0.5) | ((r2 < 0.65) & (seconds > 3600)) | ((seconds > 0.6 * limit) & (r2 < 0.72)) | (seconds > limit)
    return F.when(r2.isNull() | bad, F.lit(FAILED)).otherwise(r2 - 0.05 * F.least(seconds / 1800, F.lit(0.5)))


def blocked_objective(mean_r2: Column, seconds: Column) -> Column:
    return F.when(mean_r2.isNull(), F.lit(FAILED)).otherwise(mean_r2 - 0.05 * F.least(seconds / 7200, F.lit(1.0)))


def best_parameters(log: DataFrame, by: list[str], value: str = "value", params: str = "params") -> DataFrame:
    """The parameters (a map) of the best trial of each study, the earliest of equal ones."""
    return log.groupBy(*by).agg(F.max_by(params, F.struct(value, -F.col("trial"))).alias(params), F.max(value).alias(value))


def run(table: DataFrame, features: list[str], keys: list[str], models: list[str], n: int, folds: DataFrame | None = None, seed: str = "42", most_trees: int = 20, most_depth: int = 6) -> DataFrame:
    """A study of ``n`` trials (more for a forest) for each model: (model, trial, state, value, r2, rmse, n_folds, params).

    Trials are scored on one repeatable split, or, given a table of ``folds`` (with fold and role), by the mean over
    its folds. A trial that cannot be fitted fails and the study goes on. ``most_trees`` and ``most_depth`` bound a fit.
    """
    spark = table.sparkSession
    trials = spark.createDataFrame([(m, k) for m in models for k in range(n_trials(m, n))], "model string, trial long")
    drawn: dict = {}
    for r in sampled(trials, seed).collect():  # trials x parameters
        drawn.setdefault((r.model, r.trial), {})[r.param] = r.choice if r.choice is not None else r.number
    x = table.withColumn("_train", train.hash_split(table, keys, 0.7)).cache()
    rows = []
    for (model, trial), params in sorted(drawn.items()):
        began, spark_params = time.perf_counter(), mapped(model, params, most_trees, most_depth)
        told = {k: str(v) for k, v in params.items()}
        try:
            if folds is None:
                fitted = train.pipeline(model, features, **spark_params).fit(x.where("_train"))
                m = regression(fitted.transform(x.where("not _train")), "y", "prediction", []).first()
                r2, rmse, n_folds = m.r2, m.rmse, 1
            else:
                m = train.blocked_validation(folds, features, [model], {model: spark_params}).agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n")).first()
                r2, rmse, n_folds = m.r2, m.rmse, m.n
        except Exception:  # a trial that fails is part of a study
            r2, rmse, n_folds = None, None, 0
        rows.append((model, trial, r2, rmse, n_folds, time.perf_counter() - began, told))
    x.unpersist()
    log = spark.createDataFrame(rows, "model string, trial long, r2 double, rmse double, n_folds long, seconds double, params map<string,string>")
    value = simple_objective(F.col("r2"), F.col("seconds")) if folds is None else blocked_objective(F.col("r2"), F.col("seconds"))
    return log.withColumn("value", value).withColumn("state", F.when(F.col("value") == FAILED, "failed").otherwise("complete"))
