import duckdb

from gridscale.llm import decontaminate
from gridscale.llm.decontaminate import contained, sql


def same(spark, docs, items, con):
    got = sorted(map(tuple, contained(docs, items).collect()))
    want = sorted(con.execute(sql()).fetchall())
    assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(g[4] - w[4]) < 1e-6 for g, w in zip(got, want))
    return got


def test_table(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    r = "/root/testdata/sf0.01"
    assert same(spark, spark.read.parquet(f"{r}/documents.parquet"), spark.read.parquet(f"{r}/benchmark.parquet"), con)


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"x {item.upper()}!! y"), (2, None), (3, ""), (4, "two words here"), (5, item.replace("kappa", "other")), (6, item.replace("delta", "x")), (1, "again"), (None, item)]
    items = [(1, item), (2, "two words"), (3, ""), (4, None), (None, "x"), (5, item)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = same(spark, d, i, con)
    assert {(g[0], g[1]) for g in got} == {(1, 1), (1, 5), (4, 2), (5, 1), (5, 5)}
    # a very long text, at which DuckDB's lists take minutes
    long = spark.createDataFrame([(7, "a " * 60000 + item)], "doc_id long, text string")
    assert {(r.item_id, r.n_found, r.containment) for r in contained(long, i).collect()} == {(1, 6, 1.0), (5, 6, 1.0)}
    assert contained(d.where("false"), i).count() == 0 and contained(d, i.where("false")).count() == 0


def test_pieces_and_shuffled_sketches(spark, monkeypatch):
    r = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{r}/documents.parquet"), spark.read.parquet(f"{r}/benchmark.parquet")
    want = sorted(map(tuple, contained(docs, items).collect()))
    for rows, pieces in ((900, 8), (900, 2)):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontaminate, "PIECES", pieces)
        assert sorted(map(tuple, contained(docs, items).collect())) == want
