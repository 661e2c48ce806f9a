import numpy as np
import pytest

from gridscale.operators.series import decompose, fill_one, fill_short, gap_runs, linear_fill, rolling_sum, spatial_mean, stl_fill


def line(n=96):
    t = np.arange(n)
    return 3 + 0.5 * t + 4 * np.sin(2 * np.pi * t / 12)


def series(spark, values):
    return spark.createDataFrame([(t, 0, 0, None if v is None else float(v)) for t, v in enumerate(values)], "t int, i int, j int, value double")


def test_components_add_up_and_recover_a_line_with_a_cycle():
    y = line()
    trend, season, rest = decompose(y)
    assert np.allclose(trend + season + rest, y)
    assert np.abs(rest).max() < 0.2 and np.abs(trend - (3 + 0.5 * np.arange(96))).max() < 0.4


def test_fill_beats_straight_lines_and_keeps_what_is_known():
    y = line()
    gaps = np.random.default_rng(1).permutation(np.arange(5, 90))[:12]
    holed = y.copy()
    holed[gaps] = np.nan
    filled, told = fill_one(holed, 1)
    known = ~np.isnan(holed)
    straight = np.interp(np.arange(96), np.flatnonzero(known), holed[known])
    assert (filled[known] == y[known]).all() and told["values_filled"] == 12 and told["validation_points"] == int(0.2 * 84)
    assert np.sqrt(((filled - y)[gaps] ** 2).mean()) < np.sqrt(((straight - y)[gaps] ** 2).mean())


@pytest.mark.parametrize("valid,method,points", [(23, "insufficient_data", 0), (24, "stl", 0), (35, "stl", 0), (36, "stl", 7)])
def test_thresholds(valid, method, points):
    y = np.where(np.arange(60) < valid, line(60), np.nan)
    _, told = fill_one(y, 1)
    assert told["method"] == method and told["validation_points"] == points


@pytest.mark.parametrize("how", ["stl", "climatology", "mean_residual"])
def test_grouped_job(spark, how):
    y = [None if t in (10, 11, 40) else v for t, v in enumerate(line())]
    got = stl_fill(series(spark, y), reconstruct=how).orderBy("t").collect()
    assert len(got) == 96 and all(r.filled is not None for r in got) and all(r.filled == r.value for r in got if r.value is not None)


def test_linear_fill_and_runs(spark):
    y = [None, None, 2, None, 4, None, None, None, 8, None, None, None, None, 13, None]
    df = series(spark, y)
    assert [r.f for r in linear_fill(df, "value", "f").orderBy("t").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    assert [r.f for r in fill_short(df, "value", "f").orderBy("t").collect()] == [None, None, 2, 3, 4, 5, 6, 7, 8, None, None, None, None, 13, None]
    assert sorted((r.first, r.last, r.length) for r in gap_runs(df, "value").select("first", "last", "length").collect()) == [(0, 1, 2), (3, 3, 1), (5, 7, 3), (9, 12, 4), (14, 14, 1)]
    assert [r.f for r in series(spark, [1, None, 3]).select("t", rolling_sum("value", 2).alias("f")).orderBy("t").collect()] == [1, 1, 3]


def test_spatial_mean_repeats_edges_and_propagates_nulls(spark):
    rows = [(0, i, j, float(10 * i + j)) for i in range(3) for j in range(3)]
    got = {(r.i, r.j): r.s for r in spatial_mean(spark.createDataFrame(rows, "t int, i int, j int, value double"), "value", "s").collect()}
    assert got[1, 1] == 11 and abs(got[0, 0] - (0 * 4 + 1 * 2 + 10 * 2 + 11) / 9) < 1e-12
    rows[0] = (0, 0, 0, None)
    got = {(r.i, r.j): r.s for r in spatial_mean(spark.createDataFrame(rows, "t int, i int, j int, value double"), "value", "s").collect()}
    assert got[0, 0] is None and got[1, 1] is None and got[2, 2] is not None
