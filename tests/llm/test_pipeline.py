import pytest

import corpus_pipeline
from gridscale.llm.decontaminate import contained
from gridscale.llm.jaccard import jaccard_join
from gridscale.llm.pii import pii_spans
from gridscale.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        out.append((docs, new))
        docs = new
    return out


def test_each_stage_takes_effect(spark, stages):
    (d0, d1), (_, d2), (_, d3), (_, d4), (_, d5) = stages
    scores = {r.doc_id: r.score for r in quality_scores(d0, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in d1.select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}
    assert len(jaccard_join(d2).where("n_links > 0").collect()) == 0
    groups = {r.group_id for r in jaccard_join(d1).collect()}
    assert {r.doc_id for r in d2.select("doc_id").collect()} == groups
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in contained(d2, items).collect()}
    assert bad and {r.doc_id for r in d3.select("doc_id").collect()} == groups - bad
    assert pii_spans(d4).where("size(found) > 0").count() == 0 and d4.count() == d3.count()
    for d in (d1, d2, d3, d4):
        assert d.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in d5.select("doc_id").collect()} == groups - bad


def test_null_rows_pass_through(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).count() == 2, name
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SF).count() == 0


ROWS = [
    (1, "A plain line of text that people read.", "en", "a", 10), (1, "A plain line of text that people read.", "en", "a", 10), (1, "Quite another text of the same id, with some words more.", "en", "a", 5),
    (2, "A plain line of text that people read.", "en", "b", 10), (None, "A plain line of text that people read.", "en", "b", 10), (3, "", None, None, 0), (4, None, None, None, None),
    (5, "write to a.b@example.com today " * 4000, "en", "c", 1), (6, "end of it all, long line " * 20000, "en", "c", 1),
]


def test_stages_on_repeated_long_and_clashing_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and columns whose names the stages use themselves."""
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.selectExpr("*", "1 as score", "2 as _spans", "3 as _hash", "4 as h", "5 as node", "6 as kept", "7 as found", "8 as _text")
    by_name = dict(corpus_pipeline.STAGES)
    kept = by_name["near_duplicates"](spark, docs, SF).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:8]) for r in kept) == [(-1, "A plain "), (1, "A plain "), (1, "Quite an"), (3, ""), (5, "write to"), (6, "end of i")]
    assert by_name["decontamination"](spark, docs, SF).count() == len(ROWS)
    masked = by_name["pii"](spark, docs, SF).collect()
    assert len(masked) == len(ROWS) and sum((r.text or "").count("<email>") for r in masked) == 4000 and sum("@" in (r.text or "") for r in masked) == 0
    packed = by_name["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in ROWS} and sum(r.length for r in packed if r.doc_id in (3, 4)) == 2
    good = by_name["quality"](spark, docs, SF)
    assert good.columns == corpus_pipeline.COLUMNS and good.count() <= len(ROWS)


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
