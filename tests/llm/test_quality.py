import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridscale.llm.quality import chain_features, chains, fit, forward_backward, good_documents, line_features, objective, quality_scores, score, train


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    n_lines = np.array([3, 1, 5, 2])
    e, t = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pair, log_z = forward_backward(e, t, n_lines)
    want_pair, at = np.zeros((2, 2)), 0
    for k, n in enumerate(n_lines):
        ways = {y: np.exp(e[at : at + n] @ y + sum(t[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(ways.values())
        assert abs(np.log(z) - log_z[k]) < 1e-9
        assert np.allclose(good[at : at + n], sum(w / z * np.array(y) for y, w in ways.items()))
        for y, w in ways.items():
            for a, b in itertools.pairwise(y):
                want_pair[a, b] += w / z
        at += n
    assert np.allclose(pair, want_pair)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(7)
    n_lines = np.array([3, 1, 5, 2])
    x, y, weight = rng.normal(size=(11, 6)), np.array([1.0, 0.0, 1.0, 0.0]), rng.uniform(0.1, 1, 4)
    p = rng.normal(size=10)
    _, g = objective(p, x, y, n_lines, weight, 0.01)
    for k in range(len(p)):
        d = np.zeros(len(p))
        d[k] = 1e-5
        slope = (objective(p + d, x, y, n_lines, weight, 0.01)[0] - objective(p - d, x, y, n_lines, weight, 0.01)[0]) / 2e-5
        assert abs(slope - g[k]) < 1e-6


def test_chains_hold_every_line():
    assert chains(np.array([3, 8, 17]), 8).tolist() == [3, 8, 8, 8, 1]


def test_document_score_against_enumeration(spark):
    """The score of a short document from all labellings of its lines, in plain Python."""
    rng = np.random.default_rng(8)
    texts = ["good line of words here\nanother one follows it", "| # |\n%%%% 1 2 3\n| | |\nx", "", "one"] * 10
    model = fit(texts, np.array([1, 0, 0, 1] * 10))
    for text in texts[:4]:
        own, length, n_lines = line_features([text])
        e = chain_features(own, n_lines) @ model.weights
        ways = {w: np.exp(e @ w + sum(model.transition[a, b] for a, b in itertools.pairwise(w))) for w in itertools.product((0, 1), repeat=len(e))}
        good = sum(v * np.array(w) for w, v in ways.items()) / sum(ways.values())
        mean = np.clip((good * (length + 1e-3)).sum() / (length + 1e-3).sum(), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(model.scale * np.log(mean / (1 - mean)) + model.shift)))
        assert abs(score(model, [text, *rng.permutation(texts)])[0] - want) < 1e-9


def test_features_are_of_their_own_text():
    texts = ["one two\n| a | b |", "", "\n\n", "x" * 5000, "é é\tü", "a a a\na a a"]
    own, length, n_lines = line_features(texts)
    assert n_lines.tolist() == [2, 1, 3, 1, 1, 2] and length.sum() == sum(len(x.encode()) for t in texts for x in t.split("\n"))
    alone = np.vstack([chain_features(*[line_features([t])[i] for i in (0, 2)]) for t in texts])
    assert np.allclose(alone, chain_features(own, n_lines))


def test_held_out_accuracy(spark):
    r = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{r}/documents.parquet"), spark.read.parquet(f"{r}/labels.parquet")
    got = quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    x = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    rank, y = x.score.rank(), x.quality == 1
    auc = (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert auc > 0.98 and x.predicted[y].mean() > 0.99


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (1, None, 1.0), (2, "x\n" * 50000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels)
    assert got.count() == 4 and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality_scores(docs.where("false"), labels).count() == 0
    m = fit([], np.array([]))
    assert score(m, ["a", ""]).tolist() == [0.5, 0.5]


def test_good_documents_keep_rows_and_columns(spark):
    rows = [(1, "x", 1.0), (None, None, 2.0), (1, "y\n" * 20000, None), (1, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumnRenamed("score", "_text")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = good_documents(docs, labels)
    assert got.schema == docs.schema and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert good_documents(docs.where("false"), labels).count() == 0


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert np.isfinite(train(docs, labels, sample_bytes=1200).weights).all() and not train(docs, labels, sample_bytes=10).weights.any()


def test_one_large_labelled_text_does_not_empty_the_sample(spark):
    """Whatever its place in the order of the hash, a text over the bound is left out by itself."""
    r = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{r}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{r}/labels.parquet").select("doc_id", "quality")
    ids = spark.range(10_000, 10_400).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("id")).limit(1)  # the smallest hash of some hundred ids
    first = ids.first()[0]
    large = spark.createDataFrame([(first,)], "doc_id long").select("doc_id", F.expr("repeat('one more line of this text\n', 340000)").alias("text"))
    more = labels.unionByName(spark.createDataFrame([(first, 1)], "doc_id long, quality int"))
    assert labels.select(F.min(F.xxhash64("doc_id"))).first()[0] > more.where(f"doc_id = {first}").select(F.xxhash64("doc_id")).first()[0]
    a, b = train(docs, labels), train(docs.unionByName(large), more)
    assert np.allclose(a.weights, b.weights) and a.scale == b.scale and np.abs(a.weights).max() > 0.1
