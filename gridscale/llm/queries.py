"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers

from .common import load, spread
from . import decontaminate
from .decontaminate import contained
from .extract import extract
from .jaccard import jaccard_join
from .licences import scan_licences
from .lm import lm_scores
from .packing import pack
from .pii import digest, pii_spans
from .quality import quality_scores
from .repeats import remove_repeats
from .runs import periodic_runs, run_digest, with_period
from .sharding import shard
from .vectors import near_vectors
from .whiten import whiten


def op1_decontamination(spark, sf_dir):
    return contained(spread(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


def op2_repeats(spark, sf_dir):
    return remove_repeats(spread(load(spark, sf_dir, "documents")))


def op3_licences(spark, sf_dir):
    return scan_licences(spread(load(spark, sf_dir, "documents")))


def op4_packing(spark, sf_dir):
    return pack(spread(load(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark, sf_dir):
    return quality_scores(spread(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"))


def op6_lm(spark, sf_dir):
    return lm_scores(load(spark, sf_dir, "documents"))


def op7_jaccard(spark, sf_dir):
    return jaccard_join(spread(load(spark, sf_dir, "documents")))


def op8_pii(spark, sf_dir):
    return digest(pii_spans(spread(load(spark, sf_dir, "documents"))))


def op9_sharding(spark, sf_dir):
    return shard(load(spark, sf_dir, "documents"))


def op10_embeddings(spark, sf_dir):
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op11_whitening(spark, sf_dir):
    return whiten(spread(load(spark, sf_dir, "embeddings")))


def op12_pages(spark, sf_dir):
    return extract(spread(load(spark, sf_dir, "pages")))


def op13_runs(spark, sf_dir):
    return run_digest(periodic_runs(with_period(spread(load(spark, sf_dir, "documents"))), texts=False))


QUERIES = {"op1_decontamination": op1_decontamination, "op2_repeats": op2_repeats, "op3_licences": op3_licences, "op4_packing": op4_packing, "op5_quality": op5_quality, "op6_lm": op6_lm, "op7_jaccard": op7_jaccard, "op8_pii": op8_pii, "op9_sharding": op9_sharding, "op10_embeddings": op10_embeddings, "op11_whitening": op11_whitening, "op12_pages": op12_pages, "op13_runs": op13_runs}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.sql()}
