import random

import numpy as np

from gridscale.operators import weights
from gridscale.operators.grid import nearest_known


def test_nearest_known_equals_brute_force_without_a_cross_join(spark, capsys):
    rng = random.Random(4)
    for n, m, size, reach in ((60, 9, 40, 4), (40, 1, 300, 3), (30, 40, 12, 4)):
        cells = [(rng.randrange(size), rng.randrange(size)) for _ in range(n)]
        known = {(rng.randrange(-5, size), rng.randrange(size)): float(k) for k in range(m)}
        got = nearest_known(spark.createDataFrame(cells, "i int, j int"), spark.createDataFrame([(i, j, v) for (i, j), v in known.items()], "i int, j int, f double"), "f", reach)
        want = {c: known[min(known, key=lambda k: ((k[0] - c[0]) ** 2 + (k[1] - c[1]) ** 2, k))] for c in cells}
        rows = got.collect()
        assert {(r.i, r.j): r.f for r in rows} == want and len(rows) == len(set(cells))
    got.explain()
    assert "Cartesian" not in (told := capsys.readouterr().out) and "NestedLoop" not in told
    assert nearest_known(spark.createDataFrame(cells, "i int, j int"), spark.createDataFrame([], "i int, j int, f double"), "f").where("f is null").count() == len(set(cells))
    assert nearest_known(spark.createDataFrame([], "i int, j int"), spark.createDataFrame([(0, 0, 1.0)], "i int, j int, f double"), "f").count() == 0


def test_spline_goes_through_values_and_keeps_cubics_inside(spark):
    n, factor = 40, 5
    inverse = np.array(weights.spline_inverse(n))
    band = np.diag([4 / 6] * n) + np.diag([1 / 6] * (n - 1), 1) + np.diag([1 / 6] * (n - 1), -1)
    band[0, 1] = band[-1, -2] = 2 / 6
    assert np.abs(inverse @ band - np.eye(n)).max() < 1e-12 and weights.spline_inverse(1) == [[1.0]]
    cells = spark.createDataFrame([(i, 2) for i in range(n * factor)], "i int, j int")
    w = weights.spline(cells, factor, n, 1).toPandas()
    cubic = lambda x: 0.01 * (x - 20) ** 3 - 0.2 * x**2 + x
    told = {i: float((g.w * cubic(g.ci)).sum()) for i, g in w.groupby("i")}
    place = lambda i: (i - 2) / factor
    assert all(abs(told[2 + factor * k] - cubic(k)) < 1e-6 for k in range(n))
    assert all(abs(told[i] - cubic(place(i))) < 1e-4 for i in told if 14 < place(i) < 25)
    assert abs(w.groupby("i").w.sum() - 1).max() < 1e-7 and set(w.i) == set(range(2, n * factor - 2))


def test_triangles_are_exact_on_planes_and_cover_what_they_should(spark, capsys):
    rng = random.Random(8)
    factor, n = 5, 7
    cells = spark.createDataFrame([(i, j) for i in range(n * factor) for j in range(n * factor)] * 2, "i int, j int")
    place = lambda i: (i - 2) / factor
    plane = lambda x, y: 3 * x - 2 * y + 1
    shapes = [((0, 0), (1, 0), (1, 1)), ((0, 0), (0, 1), (1, 1)), ((0, 0), (1, 0), (0, 1)), ((1, 0), (0, 1), (1, 1))]
    for share in (1.0, 0.8, 0.4):
        known = {(a, b) for a in range(n) for b in range(n) if rng.random() < share}
        table = weights.triangulated(cells, spark.createDataFrame(sorted(known) * 2, "ci int, cj int"), factor)
        got = {}
        for r in table.collect():
            assert (r.ci, r.cj) in known and (r.i, r.j, r.ci, r.cj) not in got and r.w > 0
            got[r.i, r.j, r.ci, r.cj] = r.w
        there = {(i, j) for i, j, _, _ in got}
        for i, j in there:
            taps = {(a, b): w for (p, q, a, b), w in got.items() if (p, q) == (i, j)}
            assert abs(sum(taps.values()) - 1) < 1e-9 and abs(sum(w * plane(*c) for c, w in taps.items()) - plane(place(i), place(j))) < 1e-9 and len(taps) <= 3

        def inside(i, j):
            x, y = place(i), place(j)
            for a in (int(x // 1), int(x // 1) - 1):
                for b in (int(y // 1), int(y // 1) - 1):
                    for s in shapes:
                        c = [(a + p, b + q) for p, q in s]
                        if set(c) <= known:
                            w = np.linalg.solve(np.array([[p for p, _ in c], [q for _, q in c], [1, 1, 1]], dtype=float), [x, y, 1])
                            if w.min() > -1e-9:
                                return True
            return False

        assert there == {(i, j) for i in range(n * factor) for j in range(n * factor) if inside(i, j)}
    table.explain()
    assert "Cartesian" not in (told := capsys.readouterr().out) and "NestedLoop" not in told
    assert weights.triangulated(cells, spark.createDataFrame([], "ci int, cj int"), factor).count() == 0
