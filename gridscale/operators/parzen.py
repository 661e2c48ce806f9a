"""Adaptive studies: a tree-structured Parzen sampler, median pruning, and an append-only table of trials.

A study's finished trials are parted into good ones (the best share) and the others. For each parameter both sides give a
density: a flat prior and a normal kernel at each value (logarithms where the space is logarithmic), or smoothed counts of
choices. Candidates are drawn from the good density, and the one with the largest ratio of the two is tried next. All draws
follow from the seed, the trial's number and the table, so a study that was broken off and taken up again goes on as it
would have.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import exists
from .study import FAILED, uniform

#: Trials before the sampler adapts, candidates of a parameter, share of trials that are good, and most of them.
STARTUP, CANDIDATES, GOOD, MOST_GOOD = 10, 24, 0.2, 25
#: Finished trials, and steps of a trial, before one can be pruned.
PRUNE_AFTER, WARM_STEPS = 4, 1
LOG_SCHEMA = "study string, trial long, state string, value double, steps array<double>, params map<string,string>, seconds double"


class Pruned(Exception):
    """Raised by a trial's report when it is worse than the median of the others."""


def parted(trials: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``trials`` with ``good``: whether a trial is among the best ceil(GOOD n), MOST_GOOD at most, of its study's n; the
    earliest of equal ones first."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc(value), "trial"))
    return trials.withColumn("good", rank <= F.least(F.ceil(GOOD * F.count(F.lit(1)).over(w)), F.lit(MOST_GOOD)))


def number_density(x: Column, values: Column, n: Column, low: Column, high: Column) -> Column:
    """Density at ``x`` of a flat prior and a kernel at each of ``n`` ``values`` (an array), equally weighted."""
    width = (high - low) / F.sqrt(n + 1)
    kernels = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(-0.5 * ((x - v) / width) ** 2))
    return (1 / (high - low) + kernels / (width * 2.5066282746310002)) / (n + 1)


def densities(trials: DataFrame, candidates: DataFrame, by: list[str], x: str, low: float, high: float) -> DataFrame:
    """(by, x, l, g): densities of a numeric parameter ``x`` at ``candidates`` (by, x) under good and other trials, which
    have ``good``; one row of at most a study's values meets each candidate."""
    side = lambda good: F.array_sort(F.collect_list(F.when(F.col("good") == good, F.col(x).cast("double"))))
    both = trials.groupBy(*by).agg(side(True).alias("_l"), side(False).alias("_g"))
    at, lo, hi = F.col(x).cast("double"), F.lit(float(low)), F.lit(float(high))
    told = candidates.join(both, by)
    return told.select(*by, x, number_density(at, F.col("_l"), F.size("_l"), lo, hi).alias("l"), number_density(at, F.col("_g"), F.size("_g"), lo, hi).alias("g"))


def below_median(running: DataFrame, finished: DataFrame, by: list[str]) -> DataFrame:
    """``running`` (by, trial, step, value) with ``median`` of the finished trials' values at the step and ``pruned``: below
    it, after WARM_STEPS, where PRUNE_AFTER trials or more have got as far."""
    at = finished.groupBy(*by, "step").agg(F.percentile("value", 0.5).alias("median"), F.count("value").alias("n"))
    x = running.join(at, [*by, "step"], "left")
    return x.withColumn("pruned", F.coalesce((F.col("step") > WARM_STEPS) & (F.col("n") >= PRUNE_AFTER) & (F.col("value") < F.col("median")), F.lit(False))).drop("n")


class Study:
    """A study under ``path``; ``space`` lists (name, kind, low, high) with kind int, float or log, or (name, "choice",
    [choices])."""

    def __init__(self, spark: SparkSession, path: str, name: str, space: list[tuple], seed: str = "42"):
        self.spark, self.path, self.name, self.space, self.seed = spark, path, name, space, seed

    def trials(self) -> DataFrame:
        """What the table holds of this study; a trial that was written twice counts once."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path).where(F.col("study") == self.name).dropDuplicates(["trial"])

    def _append(self, *row) -> None:
        self.spark.createDataFrame([(self.name, *row)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def _scaled(self, p: tuple, v: Column) -> Column:
        return F.log(v) if p[1] == "log" else v

    def suggest(self, trial: int) -> dict:
        """Parameters of a trial: drawn evenly at first, then the best candidate of each parameter by the two densities."""
        done = self.trials().where(F.col("state").isin("complete", "pruned") & (F.col("value") > FAILED)).cache()
        u = lambda name, k, part: uniform(F.lit(self.name), F.lit(trial), F.lit(name), k.cast("string"), F.lit(part), F.lit(self.seed))
        early = done.count() < STARTUP
        ids = self.spark.range(1 if early else CANDIDATES).select(F.col("id").alias("k"))
        cells = parted(done, ["study"]).groupBy("study").agg(*[e for k, p in enumerate(self.space) for e in self._sides(k, p)])
        base = ids.crossJoin(F.broadcast(cells)) if not early else ids  # one row of the study's values
        row = []
        for j, p in enumerate(self.space):
            a = u(p[0], F.col("k"), "a")
            if p[1] == "choice":
                n = len(p[2])
                flat = F.get(F.array(*map(F.lit, p[2])), F.floor(a * n).cast("int"))
                pick = F.get(F.col(f"l{j}"), F.floor(a * F.size(f"l{j}")).cast("int")) if not early else None
                x = flat if early else F.when(u(p[0], F.col("k"), "b") * (F.size(f"l{j}") + n) < n, F.get(F.array(*map(F.lit, p[2])), F.floor(u(p[0], F.col("k"), "c") * n).cast("int"))).otherwise(pick)
                same = lambda side, x=x, j=j, n=n: (F.size(F.filter(F.col(f"{side}{j}"), lambda v: v == x)) + 1) / (F.size(f"{side}{j}") + n)
                ratio = F.lit(0.0) if early else F.log(same("l")) - F.log(same("g"))
            else:
                lo, hi = (self._scaled(p, F.lit(float(v))) for v in p[2:4])
                flat = lo + a * (hi - lo)
                if early:
                    x, ratio = flat, F.lit(0.0)
                else:
                    n = F.size(f"l{j}")
                    at = F.floor(u(p[0], F.col("k"), "b") * (n + 1)).cast("int")
                    normal = F.sqrt(-2 * F.log(1 - a)) * F.cos(6.283185307179586 * u(p[0], F.col("k"), "c"))
                    drawn = F.get(F.col(f"l{j}"), at) + normal * (hi - lo) / F.sqrt(n + 1)
                    x = F.greatest(lo, F.least(hi, F.when(at < n, drawn).otherwise(flat)))
                    ratio = F.log(number_density(x, F.col(f"l{j}"), n, lo, hi)) - F.log(number_density(x, F.col(f"g{j}"), F.size(f"g{j}"), lo, hi))
                x = F.exp(x) if p[1] == "log" else F.round(x) if p[1] == "int" else x
            row.append(F.max_by(x, F.struct(ratio.alias("r"), (-F.col("k")).alias("k"))).alias(p[0]))
        got = base.agg(*row).first()
        done.unpersist()
        return {p[0]: int(got[p[0]]) if p[1] == "int" else got[p[0]] for p in self.space}

    def _sides(self, k: int, p: tuple) -> list[Column]:
        v = F.col("params")[p[0]]
        v = v if p[1] == "choice" else self._scaled(p, v.cast("double"))
        return [F.array_sort(F.collect_list(F.when(F.col("good") == good, v))).alias(f"{side}{k}") for side, good in (("l", True), ("g", False))]

    def pruned(self, step: int, value: float) -> bool:
        """Whether a trial with this value at this step is below the median of the finished ones."""
        steps = self.trials().where("state = 'complete'").select("study", "trial", F.posexplode("steps").alias("step", "value")).withColumn("step", F.col("step") + 1)
        running = self.spark.createDataFrame([(self.name, -1, step, value)], "study string, trial long, step int, value double")
        return bool(below_median(running, steps, ["study"]).first()["pruned"])

    def run(self, objective: Callable[[dict, Callable[[float], None]], float], n: int, prune: bool = True) -> DataFrame:
        """Trials up to number ``n`` - 1, those in the table included; returns them all.

        ``objective`` gets the parameters and a function to report values step by step, and returns the value, or None. A
        trial that raises has failed, and the study goes on.
        """
        done = {r["trial"] for r in self.trials().select("trial").collect()}  # some hundred trials
        for trial in range(n):
            if trial in done:
                continue
            params, steps, began = self.suggest(trial), [], time.perf_counter()

            def report(value: float, steps=steps) -> None:
                steps.append(float(value))
                if prune and self.pruned(len(steps), steps[-1]):
                    raise Pruned

            try:
                value = objective(params, report)
                state = "failed" if value is None or value <= FAILED else "complete"
            except Pruned:
                value, state = steps[-1], "pruned"
            except Exception:  # a trial that fails is part of a study
                value, state = None, "failed"
            self._append(trial, state, FAILED if value is None else float(value), steps, {k: str(v) for k, v in params.items()}, time.perf_counter() - began)
        return self.trials()


def model_objective(model: str, folds: DataFrame, features: list[str], most_trees: int, most_depth: int) -> Callable:
    """Mean r2 over blocked folds (fold, role), reported fold by fold, as an objective for a model of the registry."""
    from . import train
    from .metrics import regression
    from .study import mapped

    def run(params: dict, report: Callable[[float], None]) -> float | None:
        scores = []
        for f in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:  # a row for each fold
            own = folds.where(F.col("fold") == f)
            fitted = train.pipeline(model, features, **mapped(model, params, most_trees, most_depth)).fit(own.where("role = 'train'"))
            r2 = regression(fitted.transform(own.where("role = 'test'")), "y", "prediction", []).first()["r2"]
            if r2 is not None:
                scores.append(r2)
                report(sum(scores) / len(scores))
        return sum(scores) / len(scores) if scores else None

    return run
