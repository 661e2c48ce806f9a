"""Similarity join on word shingles: MinHash banding finds candidates, full shingle sets verify them.

1. A pass over the texts gives each document a hash of its shingle set and its band hashes. Documents of one
   set are a class, carried from here on by a number, and its smallest id and its size.
2. Band hashes are shuffled; buckets with more than one class link their classes to the smallest one, and the
   connected components of these links are the groups to verify. A pair is compared if it shares a band: in a
   component all at once, or, in components of more than ``MOST`` classes, bucket by bucket, in the first band that
   the pair shares. Both ways give the same links.
3. The shingle sets of grouped classes are read once more. Groups are cut into blocks of ``BLOCK`` classes or ``BLOCK_GRAMS`` shingles and
   each pair of blocks is one unit of work, which returns link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, join_counted, join_few, partitions, text_of
from .components import components
from .words import Words, shingles

BLOCK, MOST = 256, 8192
#: Shingles of a block, and of a slice of the hash range that is counted at a time.
BLOCK_GRAMS, SLICE = 2_000_000, 1_000_000
#: Up to so many ids or hashes of documents are broadcast.
BROADCAST_IDS = 200_000
#: Up to so many classes are broadcast with their band hashes.
BROADCAST_BANDS = 40_000


def bands_and_rows(threshold: float, recall: float = 0.99999, most: int = 192) -> tuple[int, int]:
    """The most selective banding (largest rows) that finds pairs at ``threshold`` with ``recall`` in ``most`` hashes."""
    for rows in range(12, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most // 2:
            return bands, rows
    return most, 1


def _sketch(n_words: int, bands: int, rows: int):
    factors = np.random.default_rng(7).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            out = []
            for doc, h, text in zip(b["doc_id"], b["h"], b["text"], strict=True):
                s = shingles(words.of(text), n_words)
                if len(s):
                    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
                    for a in range(0, len(s), 4096):
                        low = np.minimum(low, (s[a : a + 4096, None] * factors).min(axis=0))
                    keys = [xxhash.xxh3_64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), seed=k) for k in range(bands)]
                else:
                    keys = []
                out.append((doc, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), np.array(keys, dtype=np.uint64).astype(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "h", "set_key", "n_grams", "bands"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = Words(), set()
        for b in batches:  # a row said again gives the same set
            b = b[~b["node"].isin(seen)].drop_duplicates("node")
            seen.update(b["node"])
            yield pd.DataFrame({"node": b["node"], "grams": [shingles(words.of(t), n_words).tobytes() for t in b["text"]]})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, slice by slice of the hash range."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    slices = -(-sum(map(len, sets)) // SLICE)
    ends = np.array([(k << 64) // max(slices, 1) for k in range(1, slices)], dtype=np.uint64)
    bounds = [np.r_[0, np.searchsorted(s, ends), len(s)] for s in sets]
    return sum((_shared_slice([s[b[k] : b[k + 1]] for s, b in zip(sets, bounds, strict=True)]) for k in range(slices)), np.zeros((m, m), dtype=np.int64))


def _shared_slice(sets: list[np.ndarray]) -> np.ndarray:
    """The same for one slice, through the shingles that at least two sets hold."""
    m = len(sets)
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    sizes = np.diff(np.r_[starts, len(values)])
    out = np.zeros((m, m), dtype=np.float32)
    column = np.repeat(np.arange(len(starts)), sizes)
    many = np.repeat(sizes >= max(8, m // 32), sizes)
    _, dense = np.unique(column[many], return_inverse=True)
    width = int(dense.max()) + 1 if len(dense) else 0
    for a in range(0, width, 2048):  # shingles of many sets: matrix product
        here = (dense >= a) & (dense < a + 2048)
        x = np.zeros((m, min(2048, width - a)), dtype=np.float32)
        x[rows[many][here], dense[here] - a] = 1
        out += x @ x.T
    few = ~many & np.repeat(sizes > 1, sizes)
    r, c = rows[few], column[few]
    for step in range(1, int(sizes[(sizes > 1) & (sizes < max(8, m // 32))].max(initial=1))):  # of few sets: neighbours
        same = c[step:] == c[:-step]
        i, j = r[:-step][same], r[step:][same]
        hits = np.bincount(i * m + j, minlength=m * m).reshape(m, m)
        out += hits + hits.T
    return out.astype(np.int64)


def _links(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: for each class the documents it links to, and a root it is linked with."""
    g = g.drop_duplicates("node")
    first, last = int(g["b1"].iloc[0]), int(g["b2"].iloc[0])
    band = int(g["band"].iloc[0])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in g["grams"]]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    m = len(sets)
    shared = _shared(sets)
    linked = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if first != last:
        block = g["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    keys = np.stack([np.asarray(x, dtype=np.int64) for x in g["bands"]])
    if band < 0:  # a whole component: pairs that share any band
        share = np.zeros_like(linked)
        for k in range(keys.shape[1]):
            share |= keys[:, None, k] == keys[None, :, k]
        linked &= share
    for k in range(band):  # a bucket: counted in the first band that both share
        linked &= keys[:, None, k] != keys[None, :, k]
    links = linked @ g["copies"].to_numpy()
    ids = g["node"].to_numpy()
    root = np.arange(m)
    while True:  # labels fall to the smallest index among the linked
        low = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1, initial=m))
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = links > 0
    return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})


def _verify(threshold: float):
    key = ["gid", "band", "b1", "b2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:  # sorted by unit of work; a unit may go on in the next batch
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            k = b[key].to_numpy()
            ends = np.flatnonzero(np.r_[(k[1:] != k[:-1]).any(axis=1)]) + 1 if len(b) else []
            bounds = [0, *ends]
            out = [_links(b.iloc[x:y], threshold) for x, y in pairwise(bounds) if y - x > 1]
            rest = b.iloc[bounds[-1] :]
            if out:
                yield pd.concat(out)
        if rest is not None and len(rest) > 1:
            yield _links(rest, threshold)

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id with the same shingle set), n_links (other documents
    at Jaccard ``threshold`` or more, copies included), group_id (smallest id reachable by links), text_hash
    (64 bits of the text, which tells different texts of one id apart) and kept (true for one (doc_id, text_hash) of
    each group: that of the smallest id, of the smallest hash on ties).

    Null text counts as empty; texts without words are copies of each other. Texts of fewer than ``n_words``
    words are one shingle. Repeated rows count as copies; different texts of one id are documents of their own.
    Rows with a null id are kept, with null class_id and no links. An empty table gives an empty result; further
    columns are ignored. A pair at the threshold is missed with a probability of some 0.00001, one above it less.
    """
    spark = docs.sparkSession
    bands, rows = bands_and_rows(threshold)
    t = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text"))
    known = texts.where("doc_id is not null")
    with arrow_rows(spark):
        sketch = cut(known.mapInPandas(_sketch(n_words, bands, rows), "doc_id long, h long, set_key binary, n_grams long, bands array<long>"))
    classes = sketch.groupBy("set_key").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # numbers are fixed once the table is written
    classes = cut(classes.select("set_key", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("h"), "copies", "n_grams", "bands"))
    spread = classes.select("node", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = cut(spread.groupBy("key").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams_all")).where("n > 1"))
    stars = cut(join_counted(spread, buckets.select("key", "root", "n"), "key", "n").select("node", "n_grams", "band", "key", "root"))
    comp = cut(components(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    info = cut(join_few(classes.select("node", "class_id", "h", "copies", "n_grams", "bands"), comp, "node"))
    size = cut(info.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams_all")))
    sized = cut(join_counted(info, size, "component", "m"))
    own = ["node", "copies", "bands"]
    small = sized.where(F.col("m") <= MOST).select(F.col("component").alias("gid"), F.lit(-1).alias("band"), *own, "m", "grams_all")
    wide = join_few(stars.select("key", "band", "node"), sized.where(F.col("m") > MOST).select(*own), "node", most=BROADCAST_BANDS)
    wide = join_counted(wide, buckets.select("key", F.col("n").alias("m"), "grams_all"), "key", "m").select(F.col("key").alias("gid"), "band", *own, "m", "grams_all")
    members = cut(small.unionByName(wide))

    picked = join_few(known, sized.select(F.col("class_id").alias("doc_id"), "h", "node"), ["doc_id", "h"], most=BROADCAST_IDS)
    sets = picked.select("node", "text").mapInPandas(_sets(n_words), "node long, grams binary")
    full = join_few(sets, members, "node", most=BROADCAST_BANDS)
    n_blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("grams_all") / BLOCK_GRAMS)).cast("int")
    blocks = full.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    units = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "gid", "band", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "copies", "bands", "grams"
    )
    dealt = units.repartition(4 * partitions(spark), "gid", "band", "b1", "b2").sortWithinPartitions("gid", "band", "b1", "b2")
    with arrow_rows(spark, 200):
        links = cut(dealt.mapInPandas(_verify(threshold), "node long, links long, root long"))
    n_links = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = cut(n_links.join(groups, "node"))
    told = join_few(classes.select("set_key", "node", "class_id", "h", "copies"), linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = cut(told.groupBy("component").agg(F.min(F.struct("class_id", "h")).alias("low"), F.count(F.lit(1)).alias("n")))
    told = cut(join_counted(told, lowest, "component", "n").select("set_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low", "copies"))
    result = join_counted(sketch.select("doc_id", "h", "set_key"), told, "set_key", "copies").select(
        "doc_id", "class_id", "n_links", F.col("low.class_id").alias("group_id"), F.col("h").alias("text_hash"), (F.struct(F.col("doc_id").alias("class_id"), "h") == F.col("low")).alias("kept")
    )
    unknown = texts.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group_id"), F.col("h").alias("text_hash"), F.lit(True).alias("kept")
    )
    return result.unionByName(unknown)
