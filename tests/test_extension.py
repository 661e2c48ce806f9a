import os

from gridscale.plans import registry
from gridscale.sources.bind import observed, second

from .oracle import connect, difference

SF = "/root/testdata/sf0.01"


def test_union_extension_returns_every_month(spark):
    x, y = observed(spark, SF), second(spark, SF)
    got = {(r.t, r.i, r.j): r for r in registry.QUERIES["win06_union_extension"](spark, SF).collect()}
    months = {r.t for r in x.select("t").union(y.select("t")).distinct().collect()}
    cells = {(r.i, r.j) for r in x.select("i", "j").union(y.select("i", "j")).distinct().collect()}
    assert len(got) == len(months) * len(cells) and {k[0] for k in got} == months
    late = max(months)
    known = sorted((r.t, r.other) for r in y.where("i = 3 and j = 4").collect())
    (a, va), (b, vb) = known[-2:]
    assert b < late  # orders end before shipments
    assert abs(got[late, 3, 4].other - (vb + (late - b) * (vb - va) / (b - a))) < 1e-5


def test_scale_factors_of_cells_without_suppliers(spark):
    suppliers = {(k % 20, k // 20 % 20) for (k,) in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    got = {(r.i, r.j): r.scale_factor for r in registry.QUERIES["join02_supplier_alignment"](spark, SF).collect()}
    lack = set(got) - suppliers
    assert len(got) == 400 and lack
    for i, j in lack:
        a = min(suppliers, key=lambda s: ((s[0] - i) ** 2 + (s[1] - j) ** 2, *s))
        assert got[i, j] == got[a]


def test_scale_factors_of_lines_without_a_nation(spark, tmp_path):
    name, sf = "join02_scale_alignment", str(tmp_path)
    nations = {3: 4, 8: 2, 9: None, 16: 0}
    for t in ("lineitem", "orders", "part"):
        os.symlink(f"{SF}/{t}.parquet", f"{sf}/{t}.parquet")
    spark.createDataFrame(list(nations.items()), "n_nationkey int, n_regionkey int").write.parquet(f"{sf}/nation.parquet")
    got = {(r.i, r.j): r.scale_factor for r in registry.QUERIES[name](spark, sf).collect()}
    known = [k for k, v in nations.items() if v is not None]
    assert len(got) == 400 and all(abs(f - 1 - nations[min(known, key=lambda k: (abs(k - i), k))] / 10) < 1e-5 for (i, _), f in got.items())
    assert difference(spark, connect(sf), registry.QUERIES[name], registry.ORACLE_SQL[name], sf) == ""
