"""Near-duplicate vectors by randomised-rotation binary codes.

Each distinct unit vector is rotated at random once and stored as its sign bits, a correction factor (the inner
product of the vector with its code) and the rotated vector rounded at random to four bits, some 50 bytes for 64
components. From the code of one vector and the rounded form of another, bit counts give an unbiased estimate of the
inner product and a confidence bound.

Pairs to estimate meet in hash tables keyed by sign bits of further rotations; only codes are shuffled there. Large
buckets are cut into blocks, and each pair of blocks is a unit of work. The members of a unit that are in a pair
whose upper bound reaches the threshold, no others, then get their vectors, and the unit decides its pairs in double
precision. A pair counts in the first table that it shares. Equal vectors are one class with a count. Tasks return
counts and forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, join_counted, partitions
from .components import components

BLOCK = 512
#: Standard deviations of the estimate that the confidence bound spans.
SPAN = 4.0
#: Pairs that are looked at a time.
PAIRS = 1 << 17
#: Scattered vectors that a bucket holds.
SCATTERED = 64
#: Lists of so many buckets are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000
_UNIT = ["dim", "table", "key", "b1", "b2"]


def tables_and_bits(n: int, cosine: float, recall: float = 0.998) -> tuple[int, int]:
    """Bits so that a bucket holds some SCATTERED of ``n`` scattered vectors, and tables for ``recall`` at ``cosine``."""
    bits = max(int(np.log2(max(n, 2) / SCATTERED)), 2)
    same = (1 - np.arccos(cosine) / np.pi) ** bits
    return int(np.ceil(np.log(1 - recall) / np.log1p(-same))), bits


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    u = x / np.abs(x).max(axis=1, keepdims=True)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _words(b: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(b, ((0, 0), (0, -b.shape[1] % 64))), axis=1, bitorder="little").view(np.uint64)


def codes(u: np.ndarray) -> np.ndarray:
    """Stored form of unit vectors, a row each: sign words and four bit planes, then factor, lowest level and step."""
    n, dim = u.shape
    q = u @ _rotation(dim, 0)
    factor = np.abs(q).sum(axis=1) / np.sqrt(dim)
    low = q.min(axis=1)
    step = np.maximum((q.max(axis=1) - low) / 15, 1e-12)
    level = np.clip(np.floor((q - low[:, None]) / step[:, None] + np.random.default_rng(3).random(q.shape)), 0, 15).astype(np.uint8)
    bits = np.concatenate([_words(q > 0), *(_words(level >> k & 1) for k in range(4))], axis=1)
    reals = np.column_stack([factor, low, step]).astype(np.float32)
    return np.concatenate([bits.view(np.uint8), reals.view(np.uint8)], axis=1)


def estimate(stored: np.ndarray, i: np.ndarray, j: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of <u_i, u_j> from the code of i and the rounded form of j, and their confidence radius."""
    w = -(-dim // 64)
    bits = np.ascontiguousarray(stored[:, : 40 * w]).view(np.uint64).reshape(-1, 5, w)
    factor, low, step = np.ascontiguousarray(stored[:, 40 * w :]).view(np.float32).astype(np.float64).T
    code = bits[:, 0]
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)[i]
    total = sum(np.bitwise_count(bits[:, 1 + k]).sum(axis=1, dtype=np.int64) << k for k in range(4))
    c = code[i]
    s = sum((np.bitwise_count(c & bits[j, 1 + k]).sum(axis=1, dtype=np.int64) << k) for k in range(4))
    dot = (2 * (low[j] * ones + step[j] * s) - (low[j] * dim + step[j] * total[j])) / np.sqrt(dim)
    f = factor[i]
    spread = np.maximum(1 - f * f, 0) / max(dim - 1, 1) + step[j] ** 2 / 4  # of the code, and of the rounding
    return dot / f, SPAN * np.sqrt(spread) / f


def _encode(n_tables: int, bits: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {}
        for b in batches:
            out = []
            for dim, g in b.groupby("dim"):
                if dim not in turns:
                    turns[dim] = [_rotation(dim, s) for s in range(1, 2 + n_tables * bits // dim)]
                x = np.stack([np.asarray(v, dtype=np.float64) for v in g["vector"]])
                u = _unit(x)
                signs = (np.concatenate([u @ r for r in turns[dim]], axis=1) > 0)[:, : n_tables * bits].reshape(len(u), n_tables, bits)
                keys = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                out.append(pd.DataFrame({"node": g["node"], "copies": g["copies"], "dim": dim, "vector": [v.tobytes() for v in x.astype(kind)], "code": [v.tobytes() for v in codes(u)], "keys": list(keys)}))
            if out:
                yield pd.concat(out)

    return run


def _pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within runs of the given sizes, at most about PAIRS at a time."""
    end = np.repeat(np.cumsum(size), size)
    own = np.arange(len(end))
    left, waiting = own, []
    for step in range(1, int(size.max(initial=0))):
        left = left[left + step < end[left]]
        for a in range(0, len(left), PAIRS):
            waiting.append((left[a : a + PAIRS], step))
            if sum(len(w) for w, _ in waiting) >= PAIRS:
                yield np.concatenate([w for w, _ in waiting]), np.concatenate([w + s for w, s in waiting])
                waiting = []
    if waiting:
        yield np.concatenate([w for w, _ in waiting]), np.concatenate([w + s for w, s in waiting])


def _runs(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the units of work in ``g``, and the block and whether it is one of two of each row."""
    unit = g[_UNIT].to_numpy(dtype=np.int64)
    size = np.diff(np.r_[0, np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, len(g)])
    return size, g["block"].to_numpy(), unit[:, 3] != unit[:, 4]


def _sift(g: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """The members of the units in ``g`` that are in a pair whose bound reaches ``cosine``."""
    stored = np.frombuffer(b"".join(g["code"]), dtype=np.uint8).reshape(len(g), -1)
    size, block, cross = _runs(g)
    some = np.zeros(len(g), dtype=bool)
    for i, j in _pairs(size):
        value, radius = estimate(stored, i, j, int(g["dim"].iloc[0]))
        near = (value + radius >= cosine) & ~(cross[i] & (block[i] == block[j]))
        some[i[near]] = some[j[near]] = True
    return g.loc[some, [*_UNIT, "block", "node"]]


def _link(g: pd.DataFrame, cosine: float, kind: str) -> pd.DataFrame:
    """Counts and roots over all units of work in ``g``, which is sorted by them and of one dimension."""
    u = _unit(np.frombuffer(b"".join(g["vector"]), dtype=kind).reshape(len(g), -1).astype(np.float64))
    size, block, cross = _runs(g)
    table, keys = g["table"].to_numpy(), np.stack(g["keys"].to_numpy())
    copies, ids = g["copies"].to_numpy(), g["node"].to_numpy()
    links, a, b = np.zeros(len(g), dtype=np.int64), [], []
    for i, j in _pairs(size):
        fine = ~(cross[i] & (block[i] == block[j]))
        i, j = i[fine], j[fine]
        for x in range(0, len(i), 1 << 16):
            p, q = i[x : x + (1 << 16)], j[x : x + (1 << 16)]
            exact = np.einsum("ij,ij->i", u[p], u[q]) >= cosine
            p, q = p[exact], q[exact]
            first = (keys[p] == keys[q]).argmax(axis=1) == table[p]
            p, q = p[first], q[first]
            links += np.bincount(p, copies[q], len(g)).astype(np.int64) + np.bincount(q, copies[p], len(g)).astype(np.int64)
            a.append(p)
            b.append(q)
    if not a:
        return pd.DataFrame({"node": ids[:0], "links": links[:0], "root": ids[:0]})
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(g))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = links > 0
    return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[root[some]]})


def _by_unit(work):
    """Runs ``work`` on whole units, which may go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b[_UNIT] == b[_UNIT].iloc[-1]).all(axis=1).to_numpy() if len(b) else np.array([], dtype=bool)
            rest, done = b[last], b[~last]
            for _, g in done.groupby("dim", sort=False):
                yield work(g)
        if rest is not None and len(rest) > 1:
            yield work(rest)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length or rows without an id (component_id null, kept). Repeated rows link as copies do; different
    vectors of one id are vectors of their own. An empty table gives an empty result; further columns are ignored.
    A pair at the threshold is missed with a probability of some 0.002, one above it less.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    # adding 0 turns -0 into 0, so that equal vectors are equal bytes
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0).cast(element))))
    rows = cut(rows.select("vec_id", "vector", F.when(usable, F.concat_ws(":", F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector")))).alias("same")))
    classes = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers are fixed once the table is written
    n_tables, bits = tables_and_bits(classes.count(), cosine)
    coded = cut(classes.select("node", "copies", F.size("vector").alias("dim"), "vector").mapInPandas(_encode(n_tables, bits, kind), "node long, copies long, dim int, vector binary, code binary, keys array<long>"))

    spread = coded.select("node", "dim", "code", F.posexplode("keys").alias("table", "key"))
    bucket = ["dim", "table", "key"]
    large = cut(spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK))
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    members = spread.join(few, bucket, "left").withColumn("nb", F.coalesce(F.ceil(F.col("m") / BLOCK).cast("int"), F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    members = members.select(*bucket, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "code")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(4 * partitions(spark), *_UNIT).sortWithinPartitions(*_UNIT)

    with arrow_rows(spark, 8000):
        sifted = cut(dealt(members).mapInPandas(_by_unit(lambda g: _sift(g, cosine)), "dim int, table int, key long, b1 int, b2 int, block int, node long"))
        chosen = sifted.join(coded.select("node", "copies", "vector", "keys"), "node")
        links = cut(dealt(chosen).mapInPandas(_by_unit(lambda g: _link(g, cosine, kind)), "node long, links long, root long"))
    n_links = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = classes.select("same", "node", "class_id", "copies").join(n_links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = cut(told.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    told = cut(join_counted(told, lowest, "component", "n").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"))
    linked = join_counted(rows.where("same is not null").select("vec_id", "same"), told, "same", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("same is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
