"""Removal of repeated byte strings, after prefix-free parsing.

A rolling hash over ``GRAM`` bytes picks triggers: in every window of ``LENGTH`` bytes the smallest hash, leftmost
on ties, so that equal windows have equal triggers in equal places. A trigger cuts out a phrase: all bytes of the
windows it stands for. Phrases are dealt by the trigger's hash. Of equal phrases all but the earliest are repeats
in full. Where a trigger has several phrases, those distinct phrases are its dictionary: the ``LENGTH``-byte
prefixes of their suffixes are put in order (a suffix array cut off at LENGTH bytes), and of equal neighbours all
but the earliest are repeats. As phrases reach LENGTH bytes beyond their last window, the order of the parse
behind them, which full prefix-free parsing adds, is not needed. A trigger of more than ``HOT`` distinct phrases
would be a large group: its windows are dealt one by one, by their bytes' hash, each bucket of documents sending
only its own earliest of equal ones.

The number of groups follows the bytes of the table. Texts are read in Arrow batches, triggers travel in packed columns of 29 bytes or less each, and a frequent phrase
travels once for each batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, partitions, text_of

LENGTH, GRAM = 100, 32
#: Bytes of the table for each group of triggers and each bucket of documents.
GROUP_BYTES = 16_000_000
#: Distinct phrases of a trigger beyond which its windows are dealt by their own bytes.
HOT = 4096
#: Window starts that are hashed at a time.
CHUNK = 1 << 19
#: Windows that are put in order at a time within a group of triggers.
SORTED = 1 << 18
_M = 0x9E3779B97F4A7C15
_BITS = 21
_TABLE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max
_COLUMNS = "bucket int, kind int, docs binary, variants binary, starts binary, lengths binary, grams binary"


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP = _powers(_M, CHUNK + LENGTH + 1)
_DOWN = _powers(pow(_M, -1, 1 << 64), CHUNK + LENGTH + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def phrases(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of concatenated documents: text index, first window, last window (from the document's start),
    trigger hash and phrase hash."""
    ends = np.cumsum(sizes)
    n = len(data)
    found = []
    for base in range(0, max(n - LENGTH + 1, 0), CHUNK):
        part = data[base : base + CHUNK + LENGTH - 1]
        v = _TABLE[part]
        h = v
        for k in (1, 2, 4, 8, 16):  # sums to GRAM bytes
            h = h[:-k] * np.uint64(pow(_M, k, 1 << 64)) + h[k:]
        h = _mix(h)
        low = (h >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-k], low[k:])
        rest = LENGTH - GRAM + 1 - 64
        low = np.minimum(low[:-rest], low[rest:])
        at = (low & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        p = np.arange(len(at))
        doc = np.searchsorted(ends, base + p, side="right")
        fine = base + p + LENGTH <= ends[doc]
        p, at, doc = p[fine], at[fine], doc[fine]
        if not len(p):
            continue
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(p) - 1]
        lo, hi = p[first], p[last]
        sums = np.r_[np.uint64(0), np.cumsum(v * _UP[: len(v)])]
        e = (sums[hi + LENGTH] - sums[lo]) * _DOWN[lo]
        e = _mix(e + (hi - lo).astype(np.uint64) * np.uint64(_M) + (at[first] - lo).astype(np.uint64))
        d = doc[first]
        start = ends[d] - sizes[d]
        found.append((d, base + lo - start, base + hi - start, h[at[first]], e))
    if not found:
        return tuple(np.array([], dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(r) for r in raw], dtype=np.int64), raw


def _split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    turn = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[turn], np.arange(parts + 1))
    for p in range(parts):
        if ends[p + 1] > ends[p]:
            yield p, turn[ends[p] : ends[p + 1]]


def _bucket(d: np.ndarray, var: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, by its id and the checksum of its text."""
    return (d % buckets + var.astype(np.int64) % buckets) % buckets


def _ask(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data, sizes, raw = _bytes(b["text"].tolist())
            doc, lo, hi, gram, phrase = phrases(data, sizes)
            ids, variants = b["doc"].to_numpy(dtype=np.int64), np.array([zlib.crc32(r) for r in raw], dtype=np.uint32)
            d, var = ids[doc], variants[doc]
            order = np.lexsort((lo, var, d, phrase, gram))
            new = np.r_[True, (gram[order][1:] != gram[order][:-1]) | (phrase[order][1:] != phrase[order][:-1])] if len(order) else np.array([], dtype=bool)
            group = np.cumsum(new) - 1
            head = order[new][group]
            later = np.zeros(len(doc), dtype=bool)
            later[order] = (d[order] != d[head]) | (var[order] != var[head]) | (lo[order] != lo[head])
            same = np.zeros(len(doc), dtype=bool)  # a repeated row's phrases are sent once
            same[order] = ~new
            out = []
            for p, t in _split(np.where(later, _bucket(d, var, parts), (gram % np.uint64(parts)).astype(np.int64)), parts):
                for kind, own in ((1, t[later[t]]), (0, t[~later[t] & ~same[t]])):
                    if len(own):
                        out.append((p, kind, d[own].tobytes(), var[own].tobytes(), lo[own].astype(np.uint32).tobytes(), (hi - lo)[own].astype(np.uint8).tobytes(), b"" if kind else gram[own].tobytes(), b"" if kind else phrase[own].tobytes()))
            yield pd.DataFrame(out, columns=["part", "kind", "docs", "variants", "starts", "lengths", "grams", "phrases"])

    return run


def _join(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _packed(buckets: int, kind: np.ndarray, d, var, lo, span, gram) -> list[tuple]:
    out = []
    for k in (1, 2, 3):
        own = np.flatnonzero(kind == k)
        for bucket, t in _split(_bucket(d[own], var[own], buckets), buckets):
            t = own[t]
            out.append((bucket, k, d[t].tobytes(), var[t].tobytes(), lo[t].tobytes(), span[t].tobytes(), gram[t].tobytes() if k > 1 else b""))
    return out


def _judge(buckets: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        done = g[g["kind"] == 1]
        if len(done):
            d = _join(done["docs"], "<i8")
            out += _packed(buckets, np.ones(len(d), dtype=np.int8), d, _join(done["variants"], "<u4"), _join(done["starts"], "<u4"), _join(done["lengths"], "u1"), None)
        g = g[g["kind"] == 0]
        d, var, lo, span, gram, phrase = (_join(g[c], k) for c, k in (("docs", "<i8"), ("variants", "<u4"), ("starts", "<u4"), ("lengths", "u1"), ("grams", "<u8"), ("phrases", "<u8")))
        if len(d):
            order = np.lexsort((lo, var, d, phrase, gram))
            x, y = gram[order], phrase[order]
            new_gram = np.r_[True, x[1:] != x[:-1]]
            new = new_gram | np.r_[True, y[1:] != y[:-1]]
            n_phrases = np.bincount(np.cumsum(new_gram) - 1, new)
            several = n_phrases[np.cumsum(new_gram) - 1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            o, q = order, order[head]
            later = (d[o] != d[q]) | (var[o] != var[q]) | (lo[o] != lo[q])
            kind = np.zeros(len(d), dtype=np.int8)
            kind[order] = np.where(later, 1, np.where(new & (several > HOT), 3, np.where(new & (several > 1), 2, 0)))
            out += _packed(buckets, kind, d, var, lo, span, gram)
        return pd.DataFrame(out, columns=["bucket", "kind", "docs", "variants", "starts", "lengths", "grams"])

    return run


def _compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as they travel: compressed better than the shuffle would."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield b.assign(text=[z.compress(t.encode()) for t in b["text"]])


def _texts(b: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(t) for t in b["text"]]
    return raw, b["doc"].to_numpy(dtype=np.int64), np.array([zlib.crc32(r) for r in raw], dtype=np.uint32)


def _fetch(parts: int):
    """The bytes of the phrases that must be compared, dealt by trigger; of hot triggers (kind 1) the windows' hashes,
    dealt by these; and windows that are repeats within the bucket (kind 2)."""

    def run(b: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(b) and len(g):
            raw, doc, variant = _texts(b)
            at = {(x, y): k for k, (x, y) in enumerate(zip(doc.tolist(), variant.tolist(), strict=True))}
            for kind, own in g.groupby("kind"):
                d, var, lo, span, gram = (_join(own[c], k) for c, k in (("docs", "<i8"), ("variants", "<u4"), ("starts", "<u4"), ("lengths", "u1"), ("grams", "<u8")))
                texts = [raw[at[x, y]][s : s + n + LENGTH] for x, y, s, n in zip(d.tolist(), var.tolist(), lo.tolist(), span.tolist(), strict=True)]
                if kind == 2:
                    for p, t in _split((gram % np.uint64(parts)).astype(np.int64), parts):
                        out.append((p, 0, d[t].tobytes(), var[t].tobytes(), lo[t].tobytes(), span[t].tobytes(), gram[t].tobytes(), b"".join(texts[k] for k in t)))
                    continue
                for a in range(0, len(texts), SORTED // LENGTH):
                    own_texts = texts[a : a + SORTED // LENGTH]
                    data = np.frombuffer(b"".join(own_texts), dtype=np.uint8)
                    entry, step, begin = _windows(span[a : a + len(own_texts)])
                    h1, h2 = _hashes(data, begin[entry] + step)
                    e = a + entry
                    out += _dealt_windows(parts, d[e], var[e], (lo[e] + step).astype(np.uint32), h1, h2)
        return pd.DataFrame(out, columns=["part", "kind", "docs", "variants", "starts", "lengths", "grams", "bytes"])

    return run


def _windows(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase and place in it of every window of the phrases, and where each phrase begins when they are joined."""
    size = span.astype(np.int64) + LENGTH
    n = span.astype(np.int64) + 1
    entry = np.repeat(np.arange(len(span)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n), np.cumsum(size) - size


def _hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows at ``start``."""
    window = np.ascontiguousarray(sliding_window_view(data, LENGTH)[start])
    eight = np.ascontiguousarray(np.pad(window, ((0, 0), (0, -LENGTH % 8)))).view("<u8")
    out = []
    for factor in (_M, 0xD6E8FEB86659FD93):
        h = np.zeros(len(window), dtype=np.uint64)
        for k in range(eight.shape[1]):
            h = _mix((h ^ eight[:, k]) * np.uint64(factor) + np.uint64(k))
        out.append(h)
    return out[0], out[1]


def _dealt_windows(parts: int, d, var, place, h1, h2) -> list[tuple]:
    """The earliest of equal windows to the parts of their hashes; the others are repeats, by the part of their bucket."""
    out = []
    order = np.lexsort((place, var, d, h2, h1))
    new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
    for kind, own in ((1, order[new]), (2, order[~new])):
        part = (h1[own] % np.uint64(parts)).astype(np.int64) if kind == 1 else _bucket(d[own], var[own], parts)
        for p, t in _split(part, parts):
            t = own[t]
            out.append((p, kind, d[t].tobytes(), var[t].tobytes(), place[t].astype(np.uint32).tobytes(), b"", h1[t].tobytes() if kind == 1 else b"", h2[t].tobytes() if kind == 1 else b""))
    return out


def _order(buckets: int):
    """Repeats among the suffixes of each trigger's distinct phrases."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        hot = g[g["kind"] == 1]
        d, var, place, h1, h2 = (_join(hot[c], k) for c, k in (("docs", "<i8"), ("variants", "<u4"), ("starts", "<u4"), ("grams", "<u8"), ("bytes", "<u8")))
        order = np.lexsort((place, var, d, h2, h1))
        later = order[1:][(h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
        told = g[g["kind"] == 2]
        done = [np.concatenate([x[later], _join(told[c], k)]) for x, c, k in ((d, "docs", "<i8"), (var, "variants", "<u4"), (place, "starts", "<u4"))]
        n_done = len(done[0])
        g = g[g["kind"] == 0]
        d, var, lo, span, gram = (_join(g[c], k) for c, k in (("docs", "<i8"), ("variants", "<u4"), ("starts", "<u4"), ("lengths", "u1"), ("grams", "<u8")))
        data = _join(g["bytes"], "u1")
        size = span.astype(np.int64) + LENGTH
        begin = np.cumsum(size) - size
        order = np.argsort(gram, kind="stable")
        n_windows = span.astype(np.int64)[order] + 1
        groups = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]]) if len(gram) else np.array([], dtype=np.int64)
        windows_before = np.r_[0, np.cumsum(n_windows)]
        out, a = [], 0
        if n_done:
            out += _packed(buckets, np.ones(n_done, dtype=np.int8), *done, np.zeros(n_done, dtype=np.uint8), None)
        while a < len(groups):
            b = a + 1  # whole triggers, about SORTED windows at a time
            while b < len(groups) and windows_before[groups[b] if b < len(groups) else -1] - windows_before[groups[a]] < SORTED:
                b += 1
            own = order[groups[a] : groups[b] if b < len(groups) else len(order)]
            a = b
            n = span[own].astype(np.int64) + 1
            entry = np.repeat(own, n)
            step = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
            window = sliding_window_view(data, LENGTH)[begin[entry] + step]
            word = np.ascontiguousarray(window).view(f"S{LENGTH}").ravel()
            place = lo[entry] + step
            first = np.lexsort((place, var[entry], d[entry]))
            turn = first[np.argsort(word[first], kind="stable")]
            w = word[turn]
            new = np.r_[True, w[1:] != w[:-1]]
            head = turn[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = (d[entry[turn]] != d[entry[head]]) | (var[entry[turn]] != var[entry[head]]) | (place[turn] != place[head])
            gone = np.sort(turn[later])
            if len(gone):  # neighbouring windows of a phrase make one span
                cuts = np.r_[True, (np.diff(gone) != 1) | (entry[gone][1:] != entry[gone][:-1])]
                x = gone[cuts]
                y = gone[np.r_[np.flatnonzero(cuts)[1:] - 1, len(gone) - 1]]
                e = entry[x]
                out += _packed(buckets, np.ones(len(x), dtype=np.int8), d[e], var[e], place[x].astype(np.uint32), (place[y] - place[x]).astype(np.uint8), None)
        return pd.DataFrame(out, columns=["bucket", "kind", "docs", "variants", "starts", "lengths", "grams"])

    return run


def _finish(b: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
    raw, doc, variant = _texts(b)
    d, var, lo, span = (_join(g[c], k) for c, k in (("docs", "<i8"), ("variants", "<u4"), ("starts", "<u4"), ("lengths", "u1")))
    order = np.lexsort((var, d))
    d, var, lo, hi = d[order], var[order], lo[order].astype(np.int64), lo[order].astype(np.int64) + span[order] + LENGTH
    bounds = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (var[1:] != var[:-1]), True]) if len(d) else np.array([0])
    spans = {(int(d[s]), int(var[s])): (s, e) for s, e in zip(bounds[:-1], bounds[1:], strict=True)}
    out = []
    for row, (r, x, y) in enumerate(zip(raw, doc.tolist(), variant.tolist(), strict=True)):
        removed = runs = 0
        kept = r
        if (x, y) in spans:
            s, e = spans[x, y]
            edge = np.bincount(lo[s:e], minlength=len(r) + 1).astype(np.int64) - np.bincount(hi[s:e], minlength=len(r) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = int(gone.sum())
            runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
            kept = np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()
        out.append((b["doc_id"].iloc[row], len(r), removed, runs, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that a string of LENGTH bytes covers which also starts earlier: in a document of smaller id or
    further ahead in its own. Null text counts as empty; a null id comes last; rows that repeat an id and text
    don't remove each other, and different texts of one id are ordered by checksum. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    raw_id = F.col(id_col).cast("long")
    texts = docs.select(raw_id.alias("doc_id"), F.coalesce(raw_id, F.lit(_LAST)).alias("doc"), text_of(text_col).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = buckets = max(4 * partitions(spark), -(-n_bytes // GROUP_BYTES))
    n = F.lit(buckets)
    bucket = F.pmod(F.pmod("doc", n) + F.pmod(F.crc32(F.col("text").cast("binary")), n), n).cast("int")
    small = texts.withColumn("bucket", bucket).mapInPandas(_compress, "doc_id long, doc long, text binary, bucket int")
    dealt = small.groupBy("bucket")
    with arrow_rows(spark, 500):
        asked = texts.select("doc", "text").mapInPandas(_ask(parts), "part int, kind int, docs binary, variants binary, starts binary, lengths binary, grams binary, phrases binary")
        judged = cut(asked.groupBy("part").applyInPandas(_judge(buckets), _COLUMNS))
        fetched = dealt.cogroup(judged.where("kind > 1").groupBy("bucket")).applyInPandas(_fetch(parts), "part int, kind int, docs binary, variants binary, starts binary, lengths binary, grams binary, bytes binary")
        found = cut(fetched.groupBy("part").applyInPandas(_order(buckets), _COLUMNS))
        spans = judged.where("kind = 1").unionByName(found)
        return cut(dealt.cogroup(spans.groupBy("bucket")).applyInPandas(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
