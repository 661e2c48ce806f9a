import numpy as np
import pytest

from gridscale.operators import anova
from gridscale.operators.trees import Tree


def test_closed_form_on_an_additive_function(spark):
    """f = 4 [x >= 0.25] + 2 [y >= 5 of 0..10]: variances 16 x 3/16 and 4 x 1/4."""
    t = Tree(np.array([0, 1, 1, -1, -1, -1, -1]), np.array([0.25, 5.0, 5.0, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.array([0, 0, 0, 0.0, 2.0, 4.0, 6.0]), np.ones(7))
    boxes = anova.boxes_of(spark, [t], {"x": (0.0, 1.0), "y": (0.0, 10.0), "z": (1.0, 2.0)})
    got = {r.param: r.importance for r in anova.importance(boxes).collect()}
    assert got == pytest.approx({"x": 0.75, "y": 0.25, "z": 0.0})


def test_interaction_is_no_ones_share_and_splits_outside_are_left_out(spark):
    t = Tree(np.array([0, 1, 1, -1, -1, -1, -1]), np.array([0.5, 0.5, 0.5, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.array([0, 0, 0, 1.0, -1.0, -1.0, 1.0]), np.ones(7))
    flat = Tree(np.array([0, -1, -1]), np.array([7.0, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.0, 3.0, 9.0]), np.ones(3))
    boxes = anova.boxes_of(spark, [t, flat], {"x": (0.0, 1.0), "y": (0.0, 1.0)})
    assert {r.param: r.importance for r in anova.importance(boxes).collect()} == pytest.approx({"x": 0.0, "y": 0.0})
    assert boxes.where("tree = 1").count() == 2


def test_from_a_trial_table(spark):
    space = [("x", "float", 0, 1), ("rate", "log", 1e-3, 1.0), ("kind", "choice", ["a", "b"])]
    rows = [("complete", 5.0 * (k % 10) / 10 + (k % 2), {"x": str((k % 10) / 10), "rate": str(10 ** (-3 * (k % 7) / 7)), "kind": "ab"[k % 2]}) for k in range(120)] + [("failed", -999.0, {"x": "0.5"})]
    trials = spark.createDataFrame(rows, "state string, value double, params map<string,string>")
    table, bounds = anova.encoded(trials, space)
    assert table.count() == 120 and bounds["rate"][1] == 0.0 and bounds["kind"] == (0.0, 2.0)
    got = {r.param: r.importance for r in anova.parameter_importance(trials, space, 6).collect()}
    assert sum(got.values()) <= 1 + 1e-9 and max(got, key=got.get) == "x"
