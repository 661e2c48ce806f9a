"""Benchmark decontamination: documents that contain most of a test item's word shingles.

Built-in SQL functions only. An item of n shingles keeps, as its MinHash sketch, the smallest of its shingle hashes.
Items are partitioned by size, in powers of two of n, and the partition's sizes tell how many hashes its sketches need:
a document that contains the threshold share of an item of n can miss n - ceil(threshold x n) of its shingles at
most, so with one hash more it cannot miss all, and no document needs a signature of its own length. A partition of
many items is cut further by their ids, so that every piece's sketches can be broadcast; up to ``PIECES`` pieces,
documents are searched piece by piece without a shuffle of their shingles, beyond that by one shuffled join. The
candidates' shingles are then counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Tables of item shingles up to so many rows (24 bytes each), and lists of so many ids, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Pieces of sketches that are searched one after the other.
PIECES = 8


def words_of(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words; none in a shorter text."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pieces(sketch: DataFrame, per_level: dict[int, int]) -> list[DataFrame]:
    """The sketches in pieces of at most some BROADCAST_ROWS: neighbouring size partitions together, large ones cut by id."""
    groups, rows = [[]], 0
    for level in sorted(per_level):
        if groups[-1] and rows + per_level[level] > BROADCAST_ROWS:
            groups.append([])
            rows = 0
        groups[-1].append(level)
        rows += per_level[level]
    out = []
    for levels in groups:
        own = sketch.where(F.col("level").isin(levels)).select("item_id", "h")
        cuts = -(-2 * sum(per_level[x] for x in levels) // BROADCAST_ROWS) if sum(per_level[x] for x in levels) > BROADCAST_ROWS else 1
        out += [own.where(F.pmod(F.xxhash64("item_id"), F.lit(cuts)) == k) for k in range(cuts)] if cuts > 1 else [own]
    return out


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_shingles, n_found, containment.

    Items of fewer than ``n_words`` words are one shingle of all their words; items without words match nothing.
    Null texts count as empty. Rows of one doc_id are judged together, as are rows of one item_id; rows without
    an id are left out. Empty tables give an empty result; further columns are ignored.
    """
    item_words = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), words_of(text_of(item_text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n_words))
    sizes = sorted(r[0] for r in item_words.select(size.alias("n")).distinct().collect())  # at most n_words values
    if not sizes:
        sizes = [n_words]
    runs = F.coalesce(*[F.when(size == n, _runs(F.col("w"), n)) for n in sizes])
    grams = cut(item_words.select("item_id", F.explode(runs).alias("h")).distinct())
    n_grams = grams.count()
    of_item = grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.sort_array(F.collect_list("h")).alias("hs"))
    needed = F.ceil(F.col("n_shingles") * threshold - 1e-9)
    level = F.floor(F.log2(F.col("n_shingles"))).cast("int")
    sketch = of_item.select("item_id", level.alias("level"), F.explode(F.slice("hs", F.lit(1), (F.col("n_shingles") - needed + 1).cast("int"))).alias("h"))
    sketch = cut(sketch)
    per_level = {r["level"]: r["rows"] for r in sketch.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).collect()}  # some tens of rows

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def exploded(df: DataFrame, wrap=lambda c: c) -> DataFrame:
        w = df.select("doc_id", words_of(F.col("text")).alias("w"))
        every = F.concat(*[_runs(F.col("w"), n) for n in sizes]) if len(sizes) > 1 else _runs(F.col("w"), sizes[0])
        return w.select("doc_id", F.explode(wrap(every)).alias("h"))

    pieces = _pieces(sketch, per_level)
    shingled = exploded(texts)
    if len(pieces) > PIECES:
        found = shingled.join(sketch, "h").select("doc_id", "item_id").distinct()
    else:
        found = reduce(DataFrame.unionByName, [shingled.join(F.broadcast(p), "h").select("doc_id", "item_id") for p in pieces]).distinct()
    candidates = cut(found)
    ids = candidates.select("doc_id").distinct()
    chosen = texts.join(_maybe_broadcast(ids, ids.count()), "doc_id", "left_semi")
    hits = exploded(chosen, F.array_distinct).join(_maybe_broadcast(grams, n_grams), "h").distinct()
    counted = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_found"))
    whole = of_item.select("item_id", "n_shingles")
    return (
        counted.join(candidates, ["doc_id", "item_id"])
        .join(_maybe_broadcast(whole, n_grams), "item_id")
        .where(F.col("n_found") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))
        .select("doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))
    )


def sql(threshold: float = 0.8, n_words: int = 5) -> str:
    """The same result over ``documents`` and ``benchmark`` in DuckDB."""
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH i0 AS (SELECT item_id, {split} AS w FROM benchmark WHERE item_id IS NOT NULL),
i1 AS (SELECT item_id, w, least(len(w), {n_words}) AS n FROM i0 WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g FROM i1),
it AS (SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id),
d0 AS (SELECT doc_id, {split} AS w FROM documents WHERE doc_id IS NOT NULL),
dn AS (SELECT doc_id, w, n FROM d0, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n),
dg AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS g FROM dn),
c AS (SELECT doc_id, item_id, count(*) AS n_found FROM dg JOIN ig USING (n, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment
FROM c JOIN it USING (item_id) WHERE n_found >= ceil(n_shingles * {threshold} - 1e-9)"""
