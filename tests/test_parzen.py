import math

import pytest
from pyspark.sql import functions as F

from gridscale.operators import parzen
from gridscale.operators.parzen import Study

SPACE = [("x", "float", -5, 5), ("depth", "int", 1, 40), ("rate", "log", 1e-4, 1.0), ("kind", "choice", ["a", "b", "c"])]


def value(p):
    return -((p["x"] - 2) ** 2) / 10 - (p["depth"] - 30) ** 2 / 400 - (math.log10(p["rate"]) + 2) ** 2 + (0.5 if p["kind"] == "b" else 0)


def told(study):
    return [(r.trial, r.state, r.value, r.params) for r in study.trials().orderBy("trial").collect()]


def test_a_resumed_study_equals_an_unbroken_one_and_beats_random_draws(spark, tmp_path, monkeypatch):
    objective = lambda p, report: value(p)
    whole, broken = (Study(spark, str(tmp_path / n), "s", SPACE) for n in ("a", "b"))
    whole.run(objective, 24)
    broken.run(objective, 12)
    Study(spark, str(tmp_path / "b"), "s", SPACE).run(objective, 24)
    assert told(whole) == told(broken) and len(told(whole)) == 24
    for _, _, _, p in told(whole):
        assert -5 <= float(p["x"]) <= 5 and 1 <= int(p["depth"]) <= 40 and 1e-4 * 0.999 <= float(p["rate"]) <= 1.001 and p["kind"] in "abc"
    monkeypatch.setattr(parzen, "STARTUP", 10**6)
    random = Study(spark, str(tmp_path / "r"), "s", SPACE)
    random.run(objective, 24)
    late = lambda s: sum(x[2] for x in told(s)[10:]) / 14
    assert told(random)[:10] == told(whole)[:10] and late(whole) > late(random) + 0.3 and max(x[2] for x in told(whole)) > max(x[2] for x in told(random))


def test_pruning_and_failures_are_kept_in_the_table(spark, tmp_path):
    study = Study(spark, str(tmp_path / "t"), "s", [("x", "float", 0, 1)])

    def objective(p, report):
        if study.trials().count() == 5:
            raise RuntimeError("no")
        level = 1.0 if study.trials().count() < 5 else -1.0
        for k in range(3):
            report(level + k)
        return level

    got = {r.trial: (r.state, r.steps) for r in study.run(objective, 7).collect()}
    assert got[5] == ("failed", []) and got[6] == ("pruned", [-1.0, 0.0]) and all(got[k] == ("complete", [1.0, 2.0, 3.0]) for k in range(5))
    other = Study(spark, str(tmp_path / "t"), "other", [("x", "float", 0, 1)])
    assert other.trials().count() == 0 and other.run(lambda p, report: p["x"], 1).count() == 1 and study.trials().count() == 7


def test_density_is_one_in_all(spark):
    grid = spark.range(-4000, 5001).select((F.col("id") / 1000).alias("x"))
    d = parzen.number_density(F.col("x"), F.array(F.lit(0.3), F.lit(0.6), F.lit(0.6)), F.lit(3), F.lit(0.0), F.lit(1.0))
    flat = F.when(F.col("x").between(0, 1), 0.25).otherwise(0.0)
    got = grid.agg(F.sum((d - 0.25 + flat) / 1000)).first()[0]
    assert got == pytest.approx(1.0, abs=2e-3)


def test_a_study_of_a_booster_over_folds(spark, tmp_path):
    from gridscale.operators.study import SPACES

    x = spark.range(240).select(F.col("id"), (F.col("id") % 17 * 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b")).withColumn("y", F.col("a") + 2 * F.col("b"))
    folds = x.crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("fold"))).withColumn("role", F.when(F.col("id") % 3 == F.col("fold"), "test").otherwise("train"))
    got = Study(spark, str(tmp_path / "t"), "xgb", SPACES["xgb"]).run(parzen.model_objective("xgb", folds, ["a", "b"], 3, 3), 2).collect()
    assert len(got) == 2 and all(r.state == "complete" and len(r.steps) == 2 for r in got)
