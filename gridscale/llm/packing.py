"""Packing by cutting-stock column generation.

Every document is cut into whole sequences and a remainder. The remainders' lengths, rounded up to ``WIDTH``
tokens, make a histogram of at most capacity / WIDTH classes; a linear program over fill patterns is solved by
column generation (a knapsack dynamic program prices the columns), its solution is rounded down and the rest is
filled largest first. Documents ranked within their class take the places of the patterns. What the rounding
left free is then filled exactly: as many sequences as the free places amount to are dissolved and their
documents are cut to measure. The last few tokens go to sequences of power-of-two length, so none is padded.

The driver sees only the histogram and the patterns, both bounded by the number of classes.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, cut, numbered, partitions, text_of

CAPACITY, WIDTH, END_ID = 2048, 16, 1
#: The linear program is solved to this relative gap.
GAP = 1e-3
#: Up to so many documents that are cut anew, their keys are broadcast; beyond, the join shuffles.
BROADCAST_KEYS = 200_000
#: Entries of the word cache of a Python worker.
CACHE = 200_000
KEY = ["doc_id", "h"]
#: Texts of these characters alone are split here: for them the tokenizer's normal form is lower case.
SIMPLE = re.compile(r"[\t\n\r -~¡-ÿ]*")
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if SIMPLE.fullmatch(chr(c))}

    def ids(self, text: str) -> bytes:
        if not SIMPLE.fullmatch(text) or "<|" in text:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], dtype="<u4").tobytes()
        pieces = PIECE.findall(text.lower())
        got = list(map(self.known.get, pieces))
        if None in got:
            if len(self.known) > CACHE:
                self.known.clear()
            for p in pieces:
                if p not in self.known:  # a piece is what the model sees after splitting, once its bytes are spelt
                    ids = [x.id for x in self.model.tokenize(p.translate(self.level))]
                    self.known[p] = struct.pack(f"<{len(ids)}I", *ids)
            got = list(map(self.known.__getitem__, pieces))
        got.append(END_ID.to_bytes(4, "little"))
        return b"".join(got)


def _first_pieces(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for b in batches:
            out = []
            for doc, h, text in zip(b["doc_id"], b["h"], b["text"], strict=True):
                ids = encoder.ids(text)
                n = len(ids) // 4
                out += [(doc, h, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
            yield pd.DataFrame(out, columns=["doc_id", "h", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return run


def _cut_pieces(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for b in batches:
            out = []
            for doc, text, places in zip(b["doc_id"], b["text"], b["places"], strict=True):
                ids = encoder.ids(text)
                for p in places:
                    a, n = p["start"], p["length"]
                    out.append((doc, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), len(ids) // 4, p["sequence_id"], p["offset"]))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return run


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total value of items taken any number of times, and how often each is taken."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = size <= c
        if fits.any():
            v = np.where(fits, best[np.maximum(c - size, 0)] + value, -1.0)
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], choice[c] = v[k], k
    taken, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= size[choice[c]]
    return best[capacity], taken


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination by row operations. The driver shares its cores with Spark, where the threads of a
    linear algebra library wait for each other; a basis of some hundred columns needs none."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for k in range(m):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, m:]


def patterns(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, items of each class) that cover ``demand`` exactly; sizes and capacity are in units."""
    m = len(size)
    columns = np.diag(capacity // size).astype(float)
    x = demand / np.diag(columns)
    inverse = np.diag(1.0 / np.diag(columns))
    for step in range(12 * m + 200):
        price = inverse.sum(axis=0)
        value, taken = knapsack(np.maximum(price, 0), size, capacity)
        if value <= 1 + GAP:
            break
        way = (inverse * taken).sum(axis=1)
        up = way > 1e-9
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        x -= ratio[out] * way
        x[out] = ratio[out]
        columns[:, out] = taken
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        if step % 400 == 399:
            inverse = _inverse(columns)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    found, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-x):
        a = columns[:, k].astype(np.int64)
        times = int(min(np.floor(x[k] + 1e-9), (left[a > 0] // a[a > 0]).min()))
        if times > 0:
            found.append((times, a))
            left -= times * a
    while left.any():  # what rounding down left: largest first
        a, room = np.zeros(m, dtype=np.int64), capacity
        for k in np.argsort(-size):
            a[k] = min(left[k], room // size[k])
            room -= a[k] * size[k]
        times = int((left[a > 0] // a[a > 0]).min())
        found.append((times, a))
        left -= times * a
    return found


def _running(df: DataFrame, value: str, order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in an order given by hash buckets."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = df.groupBy("_b").agg(F.sum(value).alias("_s"))  # ``buckets`` rows
    firsts = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_f"))
    own = F.sum(value).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("_o", own).join(F.broadcast(firsts), "_b").withColumn(out, F.col("_f") + F.col("_o")).drop("_b", "_f", "_o")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and gives the one token that ends every document. Repeated rows are packed as
    documents of their own; a null id is kept; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text"))
    with arrow_rows(spark):
        pieces = cut(texts.mapInPandas(_first_pieces(tokenizer, capacity), "doc_id long, h long, start long, length long, ids_crc32 long, doc_tokens long"))
    buckets = 4 * partitions(spark)
    rest = pieces.where(F.col("length") < capacity).withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    histogram = rest.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).orderBy("class").collect()
    n_whole = pieces.where(F.col("length") == capacity).count()
    tokens = sum(r["tokens"] for r in histogram)
    found = patterns(np.array([r["class"] for r in histogram], dtype=np.int64), np.array([r["n"] for r in histogram], dtype=float), capacity // width) if histogram else []
    kept = tokens // capacity  # as many sequences fill up; the others are dissolved

    table, at, first = [], np.zeros(len(histogram), dtype=np.int64), 0
    for times, a in found:
        table += [(histogram[k]["class"], int(at[k]), int(at[k] + a[k] * times), int(a[k]), first) for k in np.flatnonzero(a)]
        at += a * times
        first += times
    table = spark.createDataFrame(table, "class int, lo long, hi long, each long, first long")
    ranked = numbered(rest, ["class"], ["doc_id", "h", "start"], "rank")
    placed = (
        ranked.join(F.broadcast(table), "class")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
        .select(*pieces.columns, "class", "rank", "sequence_id")
    )
    placed = cut(placed)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole_pieces = placed.where(F.col("sequence_id") < kept).withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*columns)

    free = placed.where(F.col("sequence_id") < kept).groupBy("sequence_id").agg((capacity - F.sum("length")).alias("room")).where("room > 0")
    slots = _running(free, "room", ["sequence_id"], "a", buckets).select("sequence_id", "a", (F.col("a") + F.col("room")).alias("b"), (capacity - F.col("room")).alias("from"))
    dissolved = placed.where(F.col("sequence_id") >= kept)
    filler = _running(dissolved, "length", ["doc_id", "h", "rank"], "c", buckets).select(*KEY, "start", "c", (F.col("c") + F.col("length")).alias("d"))
    filler = cut(filler)
    axis = tokens - sum(r["length"] for r in [whole_pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()]) - tokens % capacity
    extra, number = [], kept + n_whole
    for bit in [1 << k for k in reversed(range(capacity.bit_length())) if (tokens % capacity) >> k & 1]:
        extra.append((number, axis, axis + bit, 0))
        number, axis = number + 1, axis + bit
    slots = slots.unionByName(spark.createDataFrame(extra, "sequence_id long, a long, b long, from long"))

    def blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(lo) / capacity), F.floor((F.col(hi) - 1) / capacity))))

    begin, end = F.greatest("a", "c"), F.least("b", "d")
    fitted = (
        blocks(filler, "c", "d").join(blocks(slots, "a", "b"), "block")
        .where((begin < end) & (F.floor(begin / capacity) == F.col("block")))
        .select(*KEY, F.struct((F.col("start") + begin - F.col("c")).alias("start"), (end - begin).alias("length"), "sequence_id", (F.col("from") + begin - F.col("a")).alias("offset")).alias("place"))
    )
    by_doc = fitted.groupBy(*KEY).agg(F.collect_list("place").alias("places"))  # a remainder has fewer tokens than a sequence
    keys = filler.select(*KEY).distinct()
    n_keys = keys.count()
    chosen = texts.withColumn("doc_key", F.coalesce("doc_id", F.lit(-1))).join((F.broadcast if n_keys <= BROADCAST_KEYS else lambda x: x)(keys.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_key"), "h")), ["doc_key", "h"], "left_semi").dropDuplicates(["doc_key", "h"])
    again = chosen.drop("doc_id").join(by_doc.withColumn("doc_key", F.coalesce("doc_id", F.lit(-1))), ["doc_key", "h"]).select("doc_id", "text", "places")
    with arrow_rows(spark):
        refit = cut(again.mapInPandas(_cut_pieces(tokenizer), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    full = numbered(pieces.where(F.col("length") == capacity).withColumn("_g", F.lit(0)), ["_g"], ["doc_id", "h", "start"], "n", buckets)
    full = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("n") + kept).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole_pieces.unionByName(full).unionByName(refit)
