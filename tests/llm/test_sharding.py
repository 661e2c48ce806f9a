import zlib

import numpy as np

from gridscale.llm.sharding import place, shard


def check(docs, n=24):
    d = docs.select("doc_id", "text").toPandas()
    got = shard(docs, n).toPandas()
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(d.doc_id, d.text))
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return got


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = check(docs)
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() / loads.mean() < 1.01 and loads.min() / loads.mean() > 0.99
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).all()


def test_hot_group_is_split(spark):
    docs = spark.createDataFrame([(i, "same text " * 20 if i % 3 else f"own {i} " * 20, 1, 2) for i in range(6000)], "doc_id long, text string, shard int, h int")
    got = check(docs)
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() / loads.mean() < 1.15


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, ""), (3, "é" * 50000)], "doc_id long, text string")
    got = shard(docs).toPandas()
    assert len(got) == 5 and sorted(got["size"]) == [8, 8, 8, 9, 100008]
    assert shard(docs.where("false")).count() == 0


def test_place_balances_all_three():
    rng = np.random.default_rng(1)
    items = rng.pareto(2, (20000, 1)) * [100, 17, 1] * rng.uniform(0.8, 1.2, (20000, 3))
    at = place(items, 24)
    sums = np.array([items[at == s].sum(axis=0) for s in range(24)])
    assert (np.abs(sums / sums.mean(axis=0) - 1).max(axis=0) < [0.01, 0.05, 0.05]).all()


def test_place_against_a_plain_version():
    """Largest first, to the shard of highest dot product with what is left among those with room, in plain Python."""
    rng = np.random.default_rng(4)
    items = np.ceil(rng.pareto(2, (300, 3)) * [100, 17, 1])
    total = [sum(r[d] for r in items.tolist()) for d in range(3)]
    share = [[x / t * 5 for x, t in zip(r, total)] for r in items.tolist()]
    left, want = [[1.0] * 3 for _ in range(5)], [0] * len(share)
    for k in sorted(range(len(share)), key=lambda k: -share[k][0]):
        room = [s for s in range(5) if left[s][0] >= share[k][0]]
        if room:
            want[k] = max(room, key=lambda s: (round(sum(a * b for a, b in zip(left[s], share[k])), 12), -s))
        else:
            want[k] = max(range(5), key=lambda s: (left[s][0], -s))
        left[want[k]] = [a - b for a, b in zip(left[want[k]], share[k])]
    assert place(items, 5).tolist() == want
