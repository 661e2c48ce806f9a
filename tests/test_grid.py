import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscale.operators import folds, train, weights
from gridscale.operators.attribute import shapley
from gridscale.operators.coarsen import coarsen, method_of
from gridscale.operators.grid import edges_of, in_polygon, signed_longitude
from gridscale.operators.metrics import p_value, regression


def grid(spark, f, n=20, months=2):
    return spark.createDataFrame([(t, i, j, f(t, i, j)) for t in range(months) for i in range(n) for j in range(n)], "t int, i int, j int, value double")


METHODS = {
    "bilinear": lambda c, k: weights.bilinear(c, 5, 4, 4), "nearest": lambda c, k: weights.nearest(c, 5, 4, 4), "containing": lambda c, k: weights.containing(c, 5, 4, 4),
    "cubic": lambda c, k: weights.cubic(c, 5, 4, 4), "overlap": lambda c, k: weights.overlap(c, 5.0, 4, 4), "within": lambda c, k: weights.within(c, k, 6.0),
}


@pytest.mark.parametrize("name", METHODS)
def test_constant_field_and_weights(spark, name):
    fine = grid(spark, lambda t, i, j: 7.0)
    cells = fine.select("i", "j").distinct()
    coarse = coarsen(fine, 5, {"value": "mean"}, 20, 20)
    centres = coarse.select("ci", "cj").distinct().withColumn("x", 5 * F.col("ci") + 2.0).withColumn("y", 5 * F.col("cj") + 2.0)
    w = METHODS[name](cells, centres)
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("i", "j").agg(F.sum("w").alias("s")).collect())
    got = weights.apply(w, coarse, "value", "v").collect()
    assert got and all(abs(r.v - 7) < 1e-9 for r in got)


def test_bilinear_is_exact_on_a_ramp_and_empty_outside(spark):
    fine = grid(spark, lambda t, i, j: 2.0 * i + 3.0 * j, months=1)
    coarse = coarsen(fine, 5, {"value": "mean"}, 20, 20)
    got = {(r.i, r.j): r.v for r in weights.apply(weights.bilinear(fine.select("i", "j"), 5, 4, 4), coarse, "value", "v").collect()}
    assert all(abs(v - 2 * i - 3 * j) < 1e-9 for (i, j), v in got.items()) and (0, 0) not in got and len(got) == 16 * 16


def test_smoothing_and_terrain(spark):
    flat = grid(spark, lambda t, i, j: None if (i, j) == (3, 3) else 7.0, months=1)
    got = {(r.i, r.j): r.v for r in weights.gaussian(flat, "value", "v", 20, 20).collect()}
    assert len(got) == 400 and all(abs(v - 7) < 1e-9 for v in got.values())
    ramp = grid(spark, lambda t, i, j: 100.0 * i, months=1).select("i", "j", "value")
    t = {(r.i, r.j): r for r in weights.terrain(ramp, "value", 20, 20, 28.5, 0.05).collect()}
    assert abs(t[10, 10].slope - math.degrees(math.atan(100 / (0.05 * 111320)))) < 1e-6 and abs(t[10, 10].curvature) < 1e-12


def test_blocks(spark):
    odd = spark.createDataFrame([(0, i, j, 1.0) for i in range(11) for j in range(13)], "t int, i int, j int, value double")
    assert coarsen(odd, 5, {"value": "sum"}, 11, 13).count() == 4
    rows = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, None)], "t int, i int, j int, value double")
    a = coarsen(rows.select("*", F.col("value").alias("b"), F.col("value").alias("c")), 2, {"value": "mean", "b": "sum", "c": "mode"}, 2, 2).first()
    assert (a.value, a.b, a.c) == (None, 0.0, None)
    tie = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0), (0, 1, 0, 2.0), (0, 1, 1, 1.0)], "t int, i int, j int, value double")
    assert coarsen(tie, 2, {"value": "mode"}, 2, 2).first().value == 1.0
    assert method_of("soil_sand", [("soil", "mean"), ("s", "sum")]) == "mean" and method_of("x", []) == "mean"


def test_polygon_and_longitude(spark):
    notch = edges_of([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)])
    cases = {(1.0, 1.0): True, (2.0, 3.0): False, (0.0, 0.0): True, (2.0, 0.0): True, (4.0, 2.0): True, (3.0, 3.0): True, (5.0, 1.0): False, (2.0, 2.0): True, (-1.0, 0.0): False}
    df = spark.createDataFrame([(x, y) for x, y in cases], "lon double, lat double")
    assert {(r.lon, r.lat): r.inside for r in in_polygon(df, notch).collect()} == cases
    assert spark.createDataFrame([(359.75,)], "x double").select(signed_longitude(F.col("x"))).first()[0] == -0.25


def test_metrics_and_weights(spark):
    rng = np.random.default_rng(0)
    y, g = rng.normal(size=100), rng.normal(size=100)
    r = regression(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, g)], "y double, g double"), "y", "g", []).first()
    assert abs(r.r2 - (1 - ((y - g) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9 and abs(r.r - np.corrcoef(y, g)[0, 1]) < 1e-9
    assert abs(p_value(0.5, 20) - 0.0248) < 5e-4
    s = spark.createDataFrame([("a", 0.9), ("b", 0.01)], "model string, score double")
    w = {x.model: x.weight for x in train.weights(s, "score").collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and w["b"] > 0.04


def test_folds_are_disjoint_and_one_cell_raises(spark):
    cells = spark.createDataFrame([(i, j) for i in range(10) for j in range(10)], "i int, j int")
    assert folds.spatial_blocks(cells).select("block").distinct().count() == 5
    with pytest.raises(ValueError):
        folds.spatial_blocks(cells.limit(1))


def test_attributions_add_up(spark):
    rows = [(float(k % 7), float(k % 5), float(k % 3), 2.0 * (k % 7) - (k % 5) * (k % 3)) for k in range(200)]
    x = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = train.pipeline("rf", ["a", "b", "c"], numTrees=5, maxDepth=4).fit(x)
    samples = x.limit(10).withColumn("sample_id", F.monotonically_increasing_id())
    phi, ends = shapley(model, samples, x, ["a", "b", "c"], rounds=4)
    total = {r.sample_id: r.s for r in phi.groupBy("sample_id").agg(F.sum("phi").alias("s")).collect()}
    assert all(abs(r.base + total[r.sample_id] - r.prediction) < 1e-9 for r in ends.collect())
