"""Periodic runs of words within a document, by seeds that are extended along diagonals.

A run of period q has words that equal those q places on over a stretch of at least max(q, least - q) words, so grams of
``least`` // 2 words, the overlap that every run guarantees, occur in it at a distance of q. Indexed grams give pairs of
occurrences within one document; a pair is a seed on the diagonal of its lag, and a table of how far each lag is covered
keeps a stretch from being extended twice.

Pairs stay few by a ladder of gram lengths. Grams of k words find the periods from 2k up to 4k (the shortest grams all
below too), and within that distance a gram that has no period of k / 2 or less occurs eight times at most, so only the
next eight occurrences are paired. Where all grams of a stretch have so short a period r, the stretch and its copy lie in
two neighbouring runs of period r that touch, which are known by then; ``_bridges`` derives these lags from their ends.
The ladder ends at the first length of which no gram occurs again within its distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Words of the shortest run.
LEAST = 12
#: Occurrences of a gram that follow within four times its length, if it has no period of half its length or less.
FOLLOWING = 8
#: Bytes of texts that a task gives back at a time.
OUT_BYTES = 16 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
Run = tuple[int, int, int]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def _seeds(h: np.ndarray, low: int, high: int, following: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, lag) of equal grams, low <= lag < high, each with its next ``following`` occurrences; of seeds
    at neighbouring positions of one lag only the first."""
    order = np.argsort(h, kind="stable")
    same = h[order]
    at, lags = [], []
    for t in range(1, min(following, len(h) - 1) + 1):
        lag = order[t:] - order[:-t]
        near = (same[t:] == same[:-t]) & (lag < high)
        if not near.any():
            break
        near &= lag >= low
        at.append(order[:-t][near])
        lags.append(lag[near])
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, lag = np.concatenate(at), np.concatenate(lags)
    by = np.lexsort((i, lag))
    i, lag = i[by], lag[by]
    new = np.r_[True, (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + 1)][: len(i)]
    return i[new], lag[new]


def _reach(w: np.ndarray, i: int, lag: int) -> int:
    """The first x >= i at which w[x] and w[x + lag] differ, or one of them is past the end."""
    step = 64
    end = len(w) - lag
    while i < end:
        n = min(step, end - i)
        differ = w[i : i + n] != w[i + lag : i + lag + n]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i += n
        step *= 2
    return max(i, end) if i >= end else i


def _back(w: np.ndarray, i: int, lag: int) -> int:
    """The smallest x such that w[x] ... w[i - 1] equal the words ``lag`` places on."""
    step = 64
    while i > 0:
        n = min(step, i)
        differ = (w[i - n : i] != w[i - n + lag : i + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i -= n
        step *= 2
    return i


def _smallest(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no divisor of q is a period too; a stretch of 2q words has no other periods below q."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            d = q // p
            if _reach(w, start, d) + d >= end:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _bridges(w: np.ndarray, a: Run, b: Run, least: int) -> Iterator[tuple[int, int]]:
    """Seeds (position, lag) of periods from 4r on whose stretch lies in run ``a`` and its copy in run ``b``, both of period r."""
    (a1, m, r), (a2, n, _) = a, b
    b1, b2 = a1 + m, a2 + n
    if a2 > b1:
        return
    root, inside = w[a2 : a2 + r].tobytes(), w[a1 : a1 + 2 * r - 1].tobytes()
    k = inside.find(root)
    while k >= 0 and k % w.itemsize:
        k = inside.find(root, k + 1)
    if k < 0:
        return
    q = 4 * r + (a2 - a1 - k // w.itemsize) % r
    while True:
        s, e = max(a1, a2 - q), min(b1, b2 - q)
        if e - s < q:
            return
        if e - s + q >= least:
            yield s, q
        q += r


def find_runs(w: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) of the word numbers ``w``, by start, then period.

    A run is a stretch of smallest period q, of at least max(``least``, 2q) words, that neither neighbour extends.
    """
    n, k = len(w), max(least // 2, 1)
    if n < max(least, 2):
        return []
    h = w.astype(np.uint64)
    grams = h[: max(n - k + 1, 0)].copy()
    for j in range(1, k):
        grams = grams * _P + _mixed(h[j : n - k + 1 + j] + np.uint64(j))
    grams = _mixed(grams)
    found: set[Run] = set()
    later: list[tuple[int, int]] = []
    low, high, following = 1, 4 * k, 4 * k - 1
    while low <= n // 2:
        at, lags = _seeds(grams, low, high, following)
        if not len(at) and not (later and k > 1):
            same = np.sort(grams)
            if not (same[1:] == same[:-1]).any():
                break
        seeds = sorted([*zip(lags.tolist(), at.tolist(), strict=True), *((q, i) for i, q in later if q < high)])
        later = [x for x in later if x[1] >= high]
        covered: dict[int, int] = {}
        new: dict[int, list[Run]] = {}
        for q, i in seeds:
            if i < covered.get(q, 0):
                continue
            end = _reach(w, i, q)
            covered[q] = end
            start = _back(w, i, q)
            if end - start >= max(q, least - q) and _smallest(w, start, end + q, q):
                new.setdefault(q, []).append((start, end - start + q, q))
        for q, runs in new.items():
            found.update(runs)
            for a, b in zip(runs, runs[1:], strict=False):
                later += _bridges(w, a, b, least)
        grams = _mixed(grams[: len(grams) - k] * _P + grams[k:]) if len(grams) > k else grams[:0]
        if len(grams) < 2:
            break
        low, k = high, 2 * k
        high, following = 4 * k, FOLLOWING
    return sorted(found, key=lambda x: (x[0], x[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Marks the words that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def split_words(text: str | None) -> list[bytes]:
    """Words between spaces, tabs and line ends of ASCII."""
    return (text or "").encode().split()


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), dtype=np.int32, count=len(words))


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    if runs:
        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())])


def periodic_runs(docs: DataFrame, least: int = LEAST, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed
    (the words that no run repeats, joined by a space; null unless ``texts``) and collapsed_sha256.

    Words are what stands between spaces and control characters 9 to 13. Null text counts as empty and has no runs; null
    and repeated ids and repeated rows are kept; an empty table gives an empty result; further columns are ignored. A
    document is worked in one task in memory proportional to its words, however often they repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                words = split_words(text.as_py())
                found = find_runs(_numbers(words), least)
                left = _collapsed(words, found)
                size += len(left) * texts + 24 * len(found) + 200
                rows.append((doc.as_py(), len(words), [dict(zip(("start", "length", "period"), x, strict=True)) for x in found], left.decode() if texts else None, hashlib.sha256(left).hexdigest()))
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string")


def run_digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of ``periodic_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    told = runs.withColumn("_x", longest)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_x.start")).alias("start"), F.col("_x.length").alias("length"), (-F.col("_x.period")).alias("period"),
        F.floor(1000 * F.col("_x.length") / -F.col("_x.period")).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def with_period(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), in which each tenth document by the checksum h of its id repeats itself from a word on.

    With g = floor(h / 10) and n words, words from a = g % n on follow the period 1 + floor((n - a) / (3 + g % 8)). Null
    ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n, g = F.size("_w").cast("long"), F.col("_g")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), h.alias("_h")).withColumn("_g", F.floor(F.col("_h") / 10))
    chosen = base.withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    known = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    place = lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get(F.col("_w"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return known.select("doc_id", F.when(n > 0, F.array_join(F.transform("_w", place), " ")).otherwise(F.col("text")).alias("text"))
