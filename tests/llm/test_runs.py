import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridscale.llm.queries import op13_runs
from gridscale.llm.runs import find_runs, kept_words, periodic_runs, run_digest, with_period

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute(w, least=12):
    """All runs by looking along every diagonal and comparing with every smaller period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            s = w[i : j + q]
            if length >= max(least, 2 * q) and not any(s[d:] == s[: length - d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def expected(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def _key(r):
    return str(r[0]), r[6], r[7]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    short = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()
    ids = {r.doc_id for r in short}
    got = sorted((tuple(r) for r in op13_runs(spark, sf).select(*COLUMNS).collect() if r.doc_id in ids), key=_key)
    want = sorted((expected(r.doc_id, r.text) for r in short), key=_key)
    assert got == want
    assert sum(x[1] > 0 for x in want) > 5


def test_edge_rows(spark):
    texts = [None, "", " \t\n ", "a", "x " * 11, "x " * 12, "a b c " * 9, "é ü " * 8, "a a " * 12, "a b c\x0bd\x0ce\x1ff " * 6, "the same line again\n" * 5 + "end", "0 1 " * 20 + "1 0 " * 20]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "q r s " * 6, 1), (None, None, 1), (3, "a", 1), (10, texts[10], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = sorted((tuple(r) for r in run_digest(periodic_runs(with_period(docs))).select(*COLUMNS).collect()), key=_key)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=_key)
    out = {(r.doc_id, r.collapsed) for r in periodic_runs(docs.where("doc_id in (5, 6)")).collect()}
    assert out == {(5, "x"), (6, "a b c")}
    assert all(r.collapsed is None for r in periodic_runs(docs, texts=False).collect())
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 90))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in run_digest(periodic_runs(with_period(docs))).select(*COLUMNS).collect()), key=_key)
    assert got == sorted((expected(*r) for r in rows), key=_key)


def _made(rng):
    kind, n, letters = rng.random(), rng.randint(0, 200), rng.choice([1, 2, 2, 3, 4])
    if kind < 0.3:
        return [rng.randrange(letters) for _ in range(n)]
    if kind < 0.8:  # neighbouring repetitions of one block, cut anywhere, and squares
        w = []
        while len(w) < n:
            block = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            w += (block * rng.randint(1, 20))[rng.randrange(len(block)) :]
            if rng.random() < 0.5 and w:
                w += w[-rng.randint(1, len(w)) :]
            if rng.random() < 0.3:
                w.append(rng.randrange(letters + 1))
        return w[:n]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    w = b[:n]
    for _ in range(rng.randint(0, 3) if w else 0):
        w[rng.randrange(len(w))] = rng.randrange(3)
    return w


@pytest.mark.parametrize("least", [12, 8, 4])
def test_repetitive_words(least):
    rng = random.Random(least)
    for _ in range(600):
        w = _made(rng)
        assert find_runs(np.array(w, dtype=np.int32), least) == brute(w, least), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 14)), max_size=6))
def test_any_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    assert find_runs(np.array(w, dtype=np.int32)) == brute(w)


def test_long_repetitive_texts():
    n = 200_000
    assert find_runs(np.zeros(n, dtype=np.int32)) == [(0, n, 1)]
    half = np.random.default_rng(0).integers(0, 50_000, n // 2).astype(np.int32)
    assert find_runs(np.tile(half, 2)) == [(0, n, n // 2)]
    assert kept_words(n, [(0, n, n // 2)]).sum() == n // 2
