import random

from gridscale.operators import ordered
from gridscale.operators.ordered import numbered
from gridscale.plans import metric_queries
from gridscale.plans.registry import ORACLE_SQL, QUERIES

from .oracle import connect, difference

SF = "/root/testdata/sf0.01"


def test_numbers_and_running_maxima_equal_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 200), *[7] * 60]), k, rng.choice([None, rng.random()])) for k in range(2000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, k long, n int, v double")
    want = set()
    for g in ("a", "b", None):
        best = None
        for r, (_, k, n, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, x[1] or 0, x[2])), 1):
            best = v if best is None or (v is not None and v > best) else best
            want.add((n, g, k, v, r, best))
    for stretch in (1, 90, 10**6):
        got = [(x.n, x.g, x.k, x.v, x.r, x.best) for x in numbered(df, ["g"], ["k", "n"], "r", {"best": "v"}, stretch).collect()]
        assert len(got) == len(rows) and set(got) == want
    assert numbered(df.where("false"), ["g"], ["k", "n"], "r").count() == 0


def test_no_task_orders_a_whole_study(spark, monkeypatch):
    def most(df):
        sizes = df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        return max(sizes) / sum(sizes)

    whole = sorted(map(tuple, metric_queries.running_best(spark, SF).collect()))
    monkeypatch.setattr(ordered, "STRETCH", 1500)
    assert sorted(map(tuple, metric_queries.running_best(spark, SF).collect())) == whole and len(whole) > 20_000
    assert most(metric_queries.running_best(spark, SF)) < 0.2  # a study is a third of the log
    con = connect(SF)
    for name in ("srt04_best_trial", "win08_plateau", "win09_efficiency"):
        assert difference(spark, con, QUERIES[name], ORACLE_SQL[name], SF) == ""
