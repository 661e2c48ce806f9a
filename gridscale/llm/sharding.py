"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Groups are equal texts and stay together unless one group alone is larger than a shard. Groups above
a share of all bytes are items of their own; the many small ones are pooled by the hash of their text into
a fixed number of cells of graded width, so that the last items placed are tiny. Items go, largest first, to
the shard whose residual capacity has the highest dot product with the item among the shards that still have
room for its bytes (law ``bytes``).

Only ``MAX_ITEMS`` + ``CELLS`` rows reach the driver and come back as broadcast maps, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, text_of

#: A group is placed by itself if it holds more than one part in so many of all bytes.
MAX_ITEMS = 16384
#: Cells of the pooled small groups: three bands of 2048, which hold 90 %, 9 % and 1 % of the hash space.
BAND, CELLS = 2048, 3 * 2048


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item; ``items`` has a row (bytes, tokens, rows) for each, at most MAX_ITEMS + CELLS and splits."""
    total = np.maximum(items.sum(axis=0), 1)
    share = items / total * n_shards
    left = np.ones((n_shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for k in np.argsort(-share[:, 0], kind="stable"):
        fits = left[:, 0] >= share[k, 0]
        gain = np.where(fits, left @ share[k], -np.inf) if fits.any() else left[:, 0]
        out[k] = int(np.argmax(gain))
        left[out[k]] -= share[k]
    return out


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty; repeated rows are rows of their own and are kept; a null id is kept; an empty
    table gives an empty result; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    t = text_of(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(t) + 8).cast("long").alias("size"),
            F.regexp_count(t, F.lit("\\S+")).cast("long").alias("tokens"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(t).alias("h"),
        )
    )
    key = ["h", "text_crc32", "size"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).withColumn("bytes", F.col("n") * F.col("size"))
    heavy = groups.where(F.col("bytes") * MAX_ITEMS > total).collect()  # fewer than MAX_ITEMS rows
    u = F.pmod(F.col("h"), F.lit(1 << 24)) / float(1 << 24)
    band = F.when(u < 0.9, 0).when(u < 0.99, 1).otherwise(2)
    within = F.when(u < 0.9, u / 0.9).when(u < 0.99, (u - 0.9) / 0.09).otherwise((u - 0.99) / 0.01)
    cell = (band * BAND + F.least(F.floor(within * BAND), F.lit(BAND - 1))).cast("int")
    cells = groups.where(F.col("bytes") * MAX_ITEMS <= total).groupBy(cell.alias("cell")).agg(F.sum("bytes"), F.sum("tokens"), F.sum("n")).collect()

    most = total / n_shards
    items, of_heavy = [], []
    for g in heavy:
        parts = 1 if g["bytes"] <= most else int(np.ceil(2 * g["bytes"] / most))
        of_heavy.append((len(items), parts))
        items += [(g["bytes"] / parts, g["tokens"] / parts, g["n"] / parts)] * parts
    first_cell = len(items)
    items += [tuple(c)[1:] for c in cells]
    at = place(np.array(items, dtype=float).reshape(-1, 3), n_shards)
    big = spark.createDataFrame([(g["h"], g["text_crc32"], g["size"], [int(x) for x in at[a : a + p]]) for g, (a, p) in zip(heavy, of_heavy, strict=True)], "h long, text_crc32 long, size long, shards array<int>")
    small = spark.createDataFrame([(c["cell"], int(at[first_cell + i])) for i, c in enumerate(cells)], "cell int, cell_shard int")
    placed = (
        rows.join(F.broadcast(big), key, "left")
        .withColumn("cell", cell)
        .join(F.broadcast(small), "cell", "left")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.size("shards")))
        .withColumn("shard", F.coalesce(F.expr("shards[part]"), F.col("cell_shard")))
    )
    out = numbered(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
