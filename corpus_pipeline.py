"""The corpus pipeline: drop bad documents, keep one of each near-duplicate group, drop what holds test items,
mask personal data, and pack what is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscale.llm.common import cut, join_few, load, spread
from gridscale.llm.decontaminate import contained
from gridscale.llm.jaccard import BROADCAST_IDS, jaccard_join
from gridscale.llm.packing import pack
from gridscale.llm.pii import masked
from gridscale.llm.quality import good_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold; labels only train the model.

    Null texts are scored as empty ones. Null ids, repeated ids and repeated rows are judged by their text alone.
    An empty table gives an empty one; columns beyond those of documents are dropped.
    """
    return good_documents(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, of the smallest text hash on ties.

    Rows without an id stay, for nothing tells which of them to keep. Different texts of one id are documents of
    their own; a row said again is a copy, and one of it stays. Null and empty texts are copies of each other. An
    empty table gives an empty one; columns beyond those of documents are dropped.
    """
    gone = cut(jaccard_join(docs).where("doc_id is not null and not kept").select("doc_id", F.col("text_hash").alias("_hash")).distinct())
    rows = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = join_few(rows, gone, ["doc_id", "_hash"], "left_anti", BROADCAST_IDS)
    # of repeated rows of one id and text, which are rare, all are still there
    again = cut(kept.where("doc_id is not null").groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "_hash"))
    once = join_few(kept, again, ["doc_id", "_hash"], "left_anti", BROADCAST_IDS)
    one = join_few(kept, again, ["doc_id", "_hash"], "left_semi", BROADCAST_IDS).dropDuplicates(["doc_id", "_hash"])
    return once.unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that contain no test item.

    Rows of one id are judged together; rows without an id and null texts stay. An empty table gives an empty one;
    columns beyond those of documents are dropped.
    """
    found = cut(contained(docs, load(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return join_few(docs, found, "doc_id", "left_anti", BROADCAST_IDS).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked; n_chars is that of the new text, or as it was where the text is null.

    Ids play no part, so null and repeated ones are kept; columns beyond those of documents are dropped.
    """
    out = masked(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null or empty text is the one token that ends a document.

    Repeated rows are packed as documents of their own, null ids are kept, and further columns are ignored.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: Models and packing are not expressible in SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":  # the last is the result
            docs = cut(docs)
    return docs
