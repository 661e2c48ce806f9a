"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Count tables of all orders are partitioned by hash. Documents come in blocks; a block sends the distinct n-grams
that its exploded texts hold, with their counts, to the partitions (a relation block x n-gram in packed columns).
A partition is a range of hashes; there are as many as the corpus's words need for each to hold some ``PER_PART``
n-grams at most, so that a task's memory does not grow with the corpus. A partition adds up the counts of each n-gram over all blocks and joins the sums back to the blocks that asked.
The block then scores its documents with whole-corpus counts, less the counts of the document scored, so that no
document vouches for itself. A frequent n-gram travels once for each block, not once for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, partitions, text_of
from .words import Words, mix

ALPHA = 0.4
#: Count that stands for a word which no other document holds.
UNSEEN = 0.5
#: Occurrences of n-grams for each partition of the count tables.
PER_PART = 4_000_000
#: Bits of an n-gram's 64-bit hash that don't travel. Two of the n-grams of a corpus of 10^12 share the other 56 bits
#: in one of some 70,000 cases, within 0.5 GB in one of 10^8.
_DROPPED = np.uint64(8)
_P = np.uint64(0x9E3779B97F4A7C15)


def _ids(words: list[np.ndarray], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: distinct n-gram hashes of a block, index of each n-gram, and the document of each."""
    w = np.concatenate(words) if words else np.array([], dtype=np.uint64)
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    out, h = [], w
    for n in range(1, order + 1):
        if n > 1:
            h = h[:-1] * _P + w[n - 1 :] if len(h) else h
        same = doc[: len(h)] == doc[n - 1 :] if len(h) else np.array([], dtype=bool)
        keys, at = np.unique(mix(h[same] + np.uint64(n)), return_inverse=True)
        out.append((keys, at, doc[: len(h)][same]))
    return out


def _squeeze(v: np.ndarray, size: int) -> bytes:
    """Small numbers of ``size`` bytes, byte by byte, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(v).view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def _stretch(packed: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(size, -1).T.copy().view(f"<u{size}").ravel()


def _pack(at: np.ndarray) -> bytes:
    return _squeeze(at.astype("<u4"), 4)


def _unpack(packed: bytes) -> np.ndarray:
    return _stretch(packed, 4)


def _in_order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by value, and where each partition ends in it."""
    turn = np.argsort(keys, kind="stable")
    part = ((keys[turn] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return turn, np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _key(words: list[np.ndarray]) -> bytes:
    return xxhash.xxh3_128_digest(b"|".join(w.tobytes() for w in words))


def _ask(order: int, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Words()
        for b in batches:
            words = [memory.of(t) for t in b["text"]]
            key, out = _key(words), []
            ids = _ids(words, order)
            keys = np.concatenate([k for k, _, _ in ids])
            counts = np.concatenate([np.bincount(at, minlength=len(k)) for k, at, _ in ids]).astype("<u4")
            turn, ends = _in_order(keys, parts)
            for p in np.flatnonzero(ends[1:] > ends[:-1]):
                t = turn[ends[p] : ends[p + 1]]
                step = np.diff(keys[t] >> _DROPPED, prepend=np.uint64(0))
                out.append((p, key, _squeeze(step.astype("<u8"), 8), _pack(counts[t])))
            yield pd.DataFrame(out, columns=["part", "block", "grams", "counts"])

    return run


def _answer(g: pd.DataFrame) -> pd.DataFrame:
    given = [_unpack(c) for c in g["counts"]]
    sizes = [len(c) for c in given]
    keys = np.concatenate([np.cumsum(_stretch(x, 8), dtype=np.uint64) for x in g["grams"]])
    counts = np.concatenate(given)
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts)[at]
    small = np.minimum(total, 2**32 - 1).astype("<u4")
    ends = np.cumsum(sizes)
    return pd.DataFrame({"block": g["block"], "part": g["part"], "totals": [_pack(small[e - n : e]) for e, n in zip(ends, sizes, strict=True)]})


def _blocks():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Words()
        for b in batches:
            words = [memory.of(t) for t in b["text"]]
            vocabulary, at = np.unique(np.concatenate(words) if words else np.array([], dtype=np.uint64), return_inverse=True)
            yield pd.DataFrame({
                "block": [_key(words)], "ids": [b["doc_id"].astype("Int64").tolist()], "sizes": [[len(w) for w in words]],
                "vocabulary": [vocabulary.tobytes()], "at": [_pack(at)],
            })

    return run


def score_block(order: int, words: list[np.ndarray], totals: list[np.ndarray], all_words: int) -> np.ndarray:
    """Sum of the logarithms of the scores of each document's words, given whole-corpus counts of its n-grams."""
    ids = _ids(words, order)
    n_docs = len(words)
    own_words = np.array([len(w) for w in words])
    rest = []
    for (keys, at, doc), total in zip(ids, totals, strict=True):
        _, pair, count = np.unique(doc * max(len(keys), 1) + at, return_inverse=True, return_counts=True)
        rest.append(total.astype(np.int64)[at] - count[pair])
    doc = ids[0][2]
    left = np.maximum(all_words - own_words, 1)[doc]
    score = np.log(np.maximum(rest[0], UNSEEN) / left)
    place = np.arange(len(doc)) - np.r_[0, np.cumsum(own_words)][doc]  # position in the document
    penalty = np.minimum(place, order - 1) * np.log(ALPHA)
    score += penalty
    for n in range(2, order + 1):
        here = np.flatnonzero(place >= n - 1)  # words that end an n-gram, in the order of the n-grams
        count = rest[n - 1]
        context = rest[n - 2]
        start = np.flatnonzero(place >= n - 2) if n > 2 else np.arange(len(doc))
        position = np.full(len(doc), -1)
        position[start] = np.arange(len(start))
        before = context[position[here - 1]]
        seen = count > 0
        steps = np.minimum(place[here], order - 1) - (n - 1)
        score[here[seen]] = np.log(count[seen] / before[seen]) + steps[seen] * np.log(ALPHA)
    return np.bincount(doc, score, n_docs)


def lm_scores(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (sum over its words) and mean_log_score (null without words).

    Null text counts as empty; repeated rows count as different documents, so each vouches for the other; a null
    id is kept; an empty table gives an empty result; further columns are ignored. ``docs`` must give the same
    blocks when read twice, as files do; otherwise the job fails rather than return wrong scores.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    all_words = texts.select(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    parts = max(2 * partitions(spark), -(-order * all_words // PER_PART))

    def scored(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers = answers.drop_duplicates("part").sort_values("part")
        for row in blocks.itertuples():
            vocabulary = np.frombuffer(row.vocabulary, dtype=np.uint64)
            at = _unpack(row.at)
            ends = np.cumsum(row.sizes)
            words = [vocabulary[at[e - n : e]] for e, n in zip(ends, row.sizes, strict=True)]
            ids = _ids(words, order)
            keys = np.concatenate([k for k, _, _ in ids])
            turn, _ = _in_order(keys, parts)
            got = np.concatenate([np.array([], dtype="<u4"), *map(_unpack, answers["totals"])])
            if len(got) != len(keys):
                raise RuntimeError("a block of documents has no counts: its input was not the same when read again")
            totals = np.zeros(len(keys), dtype=np.int64)
            totals[turn] = got
            cuts = np.cumsum([len(k) for k, _, _ in ids])[:-1]
            sums = score_block(order, words, np.split(totals, cuts), all_words)
            out.append(pd.DataFrame({"doc_id": pd.array(row.ids, dtype="Int64"), "n_words": row.sizes, "log_score": sums}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_words": [], "log_score": []})

    with arrow_rows(spark, 1000):
        asked = texts.mapInPandas(_ask(order, parts), "part int, block binary, grams binary, counts binary")
        answers = asked.groupBy("part").applyInPandas(_answer, "block binary, part int, totals binary")
        blocks = texts.mapInPandas(_blocks(), "block binary, ids array<long>, sizes array<long>, vocabulary binary, at binary")
        done = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, "doc_id long, n_words long, log_score double"))
    return done.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def lm_scores_relational(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same scores, from tables with a row for each n-gram: exact, without Python, and the plain form of the method.

    A table of distinct n-grams by row of ``docs``, with its counts, is joined on the n-gram with the counts of the
    whole corpus; positions, with their n-grams of each order, are joined with that, and summed by row. It writes some
    tens of times its input to disk; ``lm_scores`` is the packed form of the same joins.
    """
    t = F.lower(text_of(text_col))
    words = F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    base = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words.alias("w")))

    def gram(i, n: int):
        """The run of ``n`` words that ends at ``i``."""
        return F.when(i >= n - 1, F.array_join(F.slice("w", F.greatest(i - n + 2, F.lit(1)), n), " "))

    at = base.select("row", F.size("w").alias("own_words"), "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("i"))
    at = at.select("row", "own_words", "i", *[gram(F.col("i"), n).alias(f"g{n}") for n in range(1, order + 1)], *[gram(F.col("i") - 1, n).alias(f"c{n}") for n in range(1, order)])
    held = at.select("row", F.explode(F.array(*[f"g{n}" for n in range(1, order + 1)])).alias("g")).where("g is not null").groupBy("row", "g").agg(F.count(F.lit(1)).alias("own"))
    total = held.groupBy("g").agg(F.sum("own").alias("total"))
    rest = held.join(total, "g").select("row", "g", (F.col("total") - F.col("own")).alias("rest"))
    for name in [*[f"g{n}" for n in range(1, order + 1)], *[f"c{n}" for n in range(1, order)]]:
        at = at.join(rest.select("row", F.col("g").alias(name), F.col("rest").alias(f"n_{name}")), ["row", name], "left")
    all_words = base.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("all_words"))  # one row
    at = at.crossJoin(F.broadcast(all_words))
    deepest = F.least(F.col("i"), F.lit(order - 1))
    score = F.log(F.greatest(F.col("n_g1"), F.lit(UNSEEN)) / F.greatest(F.col("all_words") - F.col("own_words"), F.lit(1))) + deepest * float(np.log(ALPHA))
    for n in range(2, order + 1):
        score = F.when(F.col(f"n_g{n}") > 0, F.log(F.col(f"n_g{n}") / F.col(f"n_c{n - 1}")) + (deepest - (n - 1)) * float(np.log(ALPHA))).otherwise(score)
    sums = at.groupBy("row").agg(F.sum(score).alias("log_score"))
    done = base.select("row", "doc_id", F.size("w").cast("long").alias("n_words")).join(sums, "row", "left").select("doc_id", "n_words", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return done.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
