import hashlib
import random

import numpy as np
import pytest

from gridscale.llm import repeats
from gridscale.llm.repeats import remove_repeats


def brute(rows):
    """Over distinct (id, text), in order of id."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0])):
        r = (t or "").encode()
        gone = np.zeros(len(r), dtype=bool)
        for p in range(len(r) - 99):
            w = r[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[i] = (len(r), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, doc int").repartition(3)
    got = remove_repeats(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    return got


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sum(r.n_removed for r in check(spark, rows)) > 0


@pytest.mark.parametrize("hot,group", [(4096, 16_000_000), (1, 16_000_000), (3, 2000)])
def test_made_cases(spark, monkeypatch, hot, group):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP_BYTES", group)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 150, 400, 3000)]
    rows = [(i, word(rng.randrange(200)) + rng.choice(shared)[: rng.randrange(60, 3000)] + word(rng.randrange(80)) + rng.choice(shared) + word(50)) for i in range(60)]
    rows += [(70, "a" * 5000), (71, "ab" * 300 + "a" * 120), (72, None), (73, ""), (74, "\x00" * 250), (None, shared[4]), (75, rows[0][1]), (75, rows[0][1]), (76, "x" * 99)]
    check(spark, rows)


def test_line_that_all_share_between_different_neighbours(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefghijkl ") for _ in range(160))
    rows = [(i, "".join(rng.choice("mnopqrstuv ") for _ in range(90)) + line + "".join(rng.choice("wxyz ") for _ in range(90))) for i in range(300)] + [(i, line) for i in range(300, 330)] + [(None, line), (None, line)]
    assert sum(r.n_removed >= 160 for r in check(spark, rows)) >= 329


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
