import random

import numpy as np
import pytest

from gridscale.llm import common, jaccard
from gridscale.llm.components import components
from gridscale.llm.words import WORD


def brute(rows, threshold=0.8):
    def grams(t):
        w = WORD.findall((t or "").lower())
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()

    ids = [i for i, _ in rows]
    s = [grams(t) for _, t in rows]
    sim = lambda a, b: 1.0 if a == b else len(a & b) / len(a | b)
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sim(s[i], s[j]) >= threshold:
                links[i].add(j), links[j].add(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.setdefault(ids[i], (min(ids[j] for j in range(len(rows)) if s[j] == s[i]), len(links[i]), min(ids[j] for j in seen)))
    return out


def brute_by_text(rows):
    """The same by (id, text), for tables that repeat ids."""
    names = list(range(len(rows)))
    by_row = brute([(k, t) for k, (_, t) in zip(names, rows, strict=True)])
    out = []
    for k in names:
        group = [j for j in names if by_row[j][2] == by_row[k][2]]
        same = [j for j in names if by_row[j][0] == by_row[k][0]]
        out.append((rows[k][0], min(rows[j][0] for j in same), by_row[k][1], min(rows[j][0] for j in group)))
    return sorted(out)


def near(n, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(f"v{rng.randrange(900)}" for _ in range(40))) for i in range(n)]
    rows += [(3 * n, None), (3 * n + 1, ""), (3 * n + 2, "one two"), (3 * n + 3, "One, two!"), (3 * n + 4, "three"), (3 * n + 4, "three")]
    return rows


@pytest.mark.parametrize("block,most", [(512, 8192), (32, 8192), (32, 20)])
def test_against_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MOST", most)
    rows = near(150)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_different_texts_of_one_id(spark):
    a, b = near(2, seed=1)[0][1], near(9, seed=2)[3][1]
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (2, "other words")] + [(i % 7, t) for i, t in near(40, seed=9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.group_id) for r in got) == brute_by_text(rows)
    assert len({(r.doc_id, r.text_hash) for r in got if r.kept}) == len({(r.component) for r in components_of(rows)})


def components_of(rows):
    from collections import namedtuple

    Row = namedtuple("Row", "component")
    return [Row(v[2]) for v in brute([(k, t) for k, (_, t) in enumerate(rows)]).values()]


def test_hubs_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 10)
    rows = near(150, seed=12) + [(1000 + i, near(1)[0][1]) for i in range(200)]
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "x " * 100000)], "doc_id long, text string")
    assert {(r.doc_id, r.n_links) for r in jaccard.jaccard_join(docs).collect()} == {(None, 0), (1, 0)}
    assert jaccard.jaccard_join(docs.where("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    assert got == want


def test_banding_reaches_recall():
    b, r = jaccard.bands_and_rows(0.8)
    assert 1 - (1 - 0.8**r) ** b >= 0.99999 and b * r <= 96
