import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridscale.llm.packing import Encoder, pack, patterns

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs):
    """Every id in one piece, no gaps in a sequence, and no padding but to a power of two."""
    d = docs.select("doc_id", "text").toPandas()
    got = pack(docs, PATH).toPandas()
    t = Tokenizer.from_file(PATH)
    for doc, group in d.groupby("doc_id", dropna=False):
        ids = np.array(t.encode(group.text.iloc[0] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = got[got.doc_id.isna() if doc != doc else got.doc_id == doc]
        assert own.length.sum() == len(ids) * len(group) and (own.doc_tokens == len(ids)).all()
        assert len(group) > 1 or (np.sort(own.start.to_numpy())[1:] == np.sort((own.start + own.length).to_numpy())[:-1]).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.iloc[0] == 0 and (s.offset.to_numpy()[1:] == (s.offset + s.length).to_numpy()[:-1]).all()
        n = s.length.sum()
        assert n <= 2048 and n & (n - 1) == 0
    return got


def test_table(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(got) < 3 * got.doc_id.nunique()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x " * 5000, 3), (4, "a b c", 4), (4, "a b c", 4), (None, "ü <|endoftext|> Ω don't ﬁ", 5)], "doc_id long, text string, h int")
    check(docs)
    assert pack(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("text", ["Don't 'S it''s, 12½ ÀÉ×÷ßº", "a\tb\r\nc", "Ünï ... !!a'll", "'", "x" * 3000, "İ ſ K", "a\x0bb\x1cc d e"])
def test_encoder(text):
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids + [1], dtype="<u4").tobytes()


def test_patterns():
    rng = np.random.default_rng(3)
    size = np.arange(1, 129)
    demand = rng.integers(0, 4000, 128) + 1
    found = patterns(size, demand.astype(float), 128)
    assert (sum(n * a for n, a in found) == demand).all() and all(a @ size <= 128 for _, a in found)
    assert sum(n for n, _ in found) <= 1.01 * max((demand @ size) / 128, demand[64:].sum()) + 64


def test_fresh_process_with_threaded_libraries():
    """Packing of a whole table ends with as many library threads as there are cores, beside Spark in one process."""
    code = (
        "import sys; sys.path.insert(0, '.');"
        "from pyspark.sql import SparkSession;"
        "s = SparkSession.builder.master('local[4]').config('spark.sql.shuffle.partitions', '4').config('spark.ui.enabled', 'false').getOrCreate();"
        "from gridscale.llm.packing import pack; import public_tokenizers;"
        "print('sequences', pack(s.read.parquet('/root/testdata/sf0.1/documents.parquet').repartition(4), public_tokenizers.path('word_bpe_49k.json')).select('sequence_id').distinct().count())"
    )
    env = {k: v for k, v in os.environ.items() if not k.endswith("_NUM_THREADS")}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=400, check=True)
    assert int(done.stdout.split("sequences ")[1]) > 1000
