import collections
import math

import pytest

from gridscale.llm import lm
from gridscale.llm.lm import lm_scores, lm_scores_relational
from gridscale.llm.words import WORD


def brute(texts, order, all_words):
    docs = [WORD.findall((t or "").lower()) for t in texts]
    count = [collections.Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    out = []
    for w in docs:
        own = [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
        c = lambda g: count[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        s = 0.0
        for i in range(len(w)):
            k = min(i, order - 1)
            for n in range(k, -1, -1):
                g = tuple(w[i - n : i + 1])
                if n == 0:
                    s += (k - n) * math.log(0.4) + math.log(max(c(g), 0.5) / max(all_words - len(w), 1))
                elif c(g) > 0:
                    s += (k - n) * math.log(0.4) + math.log(c(g) / c(g[:-1]))
                    break
        out.append(s)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "Ünï the of"), (1003, "the"), (1004, "the the the"), (1004, "the the the")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id, r.log_score) for r in lm_scores(docs, order).collect())
    n = sum(len(WORD.findall((t or "").lower())) for _, t in rows)
    want = sorted(zip([i for i, _ in rows], brute([t for _, t in rows], order, n)))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 * max(1, abs(w[1])) for g, w in zip(got, want))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores(docs).count() == 0
    assert lm_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().n_words == 2


def test_relational_form_and_many_partitions(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (7, ""), (7, "a b a b a b"), (7, "a b a b a b")], "doc_id long, text string"))
    key = lambda r: (r.doc_id or -1, r.n_words, round(r.log_score, 6), None if r.mean_log_score is None else round(r.mean_log_score, 6))
    want = sorted(map(key, lm_scores_relational(docs).collect()), key=str)
    assert sorted(map(key, lm_scores(docs).collect()), key=str) == want
    monkeypatch.setattr(lm, "PER_PART", 5000)
    assert sorted(map(key, lm_scores(docs).collect()), key=str) == want
