import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscale.llm.pii import digest, masked, pii_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a@b.c_d@e.f x@y x@y.z. end", "a@b.co@c.de", "😀 +1 (017) 555-7713 é 4111 1111 1111 1111 card", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 1.2.3",
    "4" * 30 + " " + "0" * 16, "\x01a@b.cd\x02 \x03", "+1+1 23456789012", "a." * 5000 + "@" + "b." * 5000 + "c", "1" * 40000, "1 " * 30000, "x" * 100000, "",
    "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789 or 123-45-6789", "-4111-1111-1111-1111-", "%+-@a.b", "1.1.1.1" * 2000, "é@b.cd ü.a@b.c",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(list(PLAIN)[k], a, b) for a, k, b in sorted(out)]


def compare(spark, docs):
    got = digest(pii_spans(docs)).toPandas().set_index("doc_id")
    for r in docs.toPandas().itertuples():
        want = plain(r.text or "")
        g = got.loc[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (r.text or "")[:100]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, found string")
    compare(spark, docs)
    spans = digest(pii_spans(docs)).where("doc_id = 12").first()["spans"]
    assert spans.startswith("iban:5:32") and "ssn:" in spans


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_table(spark, sf):
    compare(spark, spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text"))


def test_mask_and_empty(spark):
    docs = spark.createDataFrame([(1, "é to a@b.cd now", 5), (2, None, 1), (3, "", 0), (4, "1.2.3.4a@b.cd", 2)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in masked(docs).collect()}
    assert got == {1: "é to <email> now", 2: None, 3: "", 4: "<email>"}
    assert pii_spans(docs.where("false")).count() == 0
    assert digest(pii_spans(docs.union(docs))).count() == 8


def test_iban_before_capitals_and_context_on_both_sides(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [
        f"{iban} BIC COBADEFF", f"pay {iban} 2024", f"{iban.replace(' ', '')} {iban} GB82 WEST 1234 5698 7654 32 X", f"AB12 {iban}", "DE89 3704 0044 0532 0130 01 BIC",
        "123-45-6789 (social security)", "123-45-6789, 123-45-6788 and 123-45-6787 are ssn", "ssn: 123-45-6789, 123-45-6788", "123-45-6789" + " " * 41 + "ssn", "plain 123-45-6789 number",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in masked(docs).collect()}
    assert got == {
        0: "<iban> BIC COBADEFF", 1: "pay <iban> 2024", 2: "<iban> <iban> <iban> X", 3: "AB12 <iban>", 4: texts[4],
        5: "<ssn> (social security)", 6: "<ssn>, <ssn> and <ssn> are ssn", 7: "ssn: <ssn>, <ssn>", 8: texts[8], 9: texts[9],
    }


def test_many_spans_and_a_clashing_column(spark):
    text = "call +49 30 1234567 or write a.b@example.com now; " * 5000
    docs = spark.createDataFrame([(1, text, 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, _spans int")
    got = {r.doc_id: r for r in digest(pii_spans(docs)).collect()}
    assert got[1].n_email == got[1].n_phone == 5000 and got[2].n_email == got[3].n_email == 0
    out = {r.doc_id: r for r in masked(docs).collect()}
    assert out[1].text == "call <phone> or write <email> now; " * 5000 and out[2].text is None and out[3].text == "" and out[1]._spans == 7
