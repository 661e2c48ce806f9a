import re

import numpy as np

from gridscale.llm import licences
from gridscale.llm.licences import BITS, CLASSES, CONFIRM, FAMILIES, LEAST, TEMPLATES, scan_licences, statements, train, windows
from gridscale.llm.words import WORD, Words, grams


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    assert len(got) == len(texts)
    marks = {"apache": "Apache License", "cc-by-nc": "CC BY-NC", "gpl": "GNU General Public", "mit": "MIT License"}
    right = {k for k, t in texts.items() for f, m in marks.items() if m in t and got[k].family == f}
    there = {k for k, t in texts.items() if any(m in t for m in marks.values())}
    # "All rights reserved." is licence language, too
    wrong = {k for k, r in got.items() if r.family != "none" and not re.search(r"(?i)licen[cs]e|^all rights reserved\.$", texts[k], re.M)}
    assert len(right) > 0.99 * len(there) and len(wrong) <= 0.001 * len(texts)
    k = next(iter(right))
    assert re.search(r"(?i)licen[cs]e", texts[k].split("\n")[got[k].line_no])


def test_families_unknown_and_edges(spark):
    rows = [(k, "some text here\n" + TEMPLATES[f][0] + ".") for k, f in enumerate(FAMILIES)]
    rows += [(50, None), (51, ""), (None, "plain words"), (52, "word " * 3000 + TEMPLATES["mit"][0] + " word" * 3000), (53, "Licensed under the Zorbly License, version 1.2"), (53, "Licensed under the Zorbly License, version 1.2")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    got = {r.doc_id: r.family for r in scan_licences(docs).collect()}
    assert all(got[k] == f for k, f in enumerate(FAMILIES))
    assert got[50] == got[51] == got[None] == "none" and got[52] == "mit" and got[53] == "unknown"
    assert scan_licences(docs).count() == len(rows) and scan_licences(docs.where("false")).count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 64, 65, 96, 97, 500):
        assert set(range(n)) == {i for a, b in windows(n) for i in range(a, b)}


def test_bare_wrapped_and_several(spark):
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as published by the Free Software Foundation."
    rows = [
        (1, "some text here\nAll rights reserved.\nmore text"), (2, f"intro words\n\n{header}\n\nfurther words"), (3, header.replace("\n", "\n\n")),
        (4, "Released under the MIT License.\nplain line\nLicensed under the Apache License, Version 2.0."), (5, "Licensed under CC BY-NC 4.0."), (6, "plain words only"),
        (7, "Licensed under the MIT License or licensed under the BSD License"),
    ]
    ordinary = [(100 + k, f"the river number {k} runs past the old mill\nand people of the town walk there in the evening") for k in range(200)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows + ordinary, "doc_id long, text string")).collect()}
    assert got[1].family == "unknown" and got[1].line_no == 1 and got[1].families == []
    assert got[2].family == "gpl" and got[2].families == ["gpl"] and got[3].families == [] and got[2].line_no in (2, 3)
    assert got[4].families == ["apache", "mit"] and got[4].n_found >= 1 and got[5].families == ["cc-by-nc"] and got[7].families == ["bsd", "mit"]
    assert got[6].family == "none" and all(got[k].family == "none" for k, _ in ordinary)


def test_bare_statements_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    bare = {k for k, t in texts.items() if "All rights reserved." in t.split("\n")}
    wrong = {k for k, r in got.items() if r.family != "none" and k not in bare and not re.search(r"(?i)licen[cs]e", texts[k])}
    assert len(bare) == 66 and sum(got[k].family != "none" for k in bare) >= 65 and len(wrong) <= 0.001 * len(texts)


VARIANTS = [
    ("This program is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation; you can redistribute it and/or modify it", "agpl"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation.", "lgpl"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by", "gpl"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Licensed under CC0 1.0 Universal.", "cc0"), ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "isc"), ("Licensed under the ISC License.", "isc"),
    ("# SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"), ("License: MIT", "mit"), ("License: BSD-3-Clause", "bsd"), ("Licensed under CC BY 3.0.", "cc-by"), ("Licensed under CC BY-NC-SA 2.0.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by"), ("This work is licensed under a Creative Commons Attribution-NonCommercial 2.5 Generic License.", "cc-by-nc"),
    ("Licensed under the zlib License.", "zlib"), ("Distributed under the Boost Software License, Version 1.0.", "boost"), ("do what the fuck you want to public license", "wtfpl"), ("Licensed under the Artistic License 2.0.", "artistic"),
    ("Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license to use it", "boost"),
    ("This program is licensed under the GNU General Public License, version 2.", "gpl"), ("SPDX-License-Identifier: LicenseRef-zorbly", "unknown"),
]


def test_variants(spark):
    ordinary = [(100 + k, f"the river number {k} runs past the old mill\nand people of the town walk there in the evening") for k in range(100)]
    rows = [(k, f"some words\n\n{text}\n\nmore words") for k, (text, _) in enumerate(VARIANTS)]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame([*rows, *ordinary], "doc_id long, text string"), sample=30).collect()}
    for k, (text, family) in enumerate(VARIANTS):
        assert got[k].family == family and got[k].families == [family] * (family != "unknown"), (text, got[k])


def brute(model, text):
    """Family, families and number of stretches of a text, stretch by stretch in plain Python."""
    memory = Words()
    named = [(k, {tuple(p) for p in _pairs(t)}) for k, f in enumerate(FAMILIES) for t in statements(f)]
    own = [t - set().union(*(x for j, x in named if j != k)) for k, t in named]
    lines = []
    for n, line in enumerate(text.split("\n")):
        w = WORD.findall(line.lower())
        w = [x for k, x in enumerate(w) if k == 0 or x != w[k - 1]]
        if w:
            lines.append((n, w))
    paragraphs = []
    for n, w in lines:
        if paragraphs and paragraphs[-1][-1][0] == n - 1:
            paragraphs[-1].append((n, w))
        else:
            paragraphs.append([(n, w)])
    found, at = [], 0
    for p in paragraphs:
        words = [(x, n) for n, w in p for x in w]
        spans, first = set(), 0
        for _, w in p:
            spans |= {(first + a, first + z) for a, z in windows(len(w))}
            first += len(w)
        if len(p) > 1:
            spans |= {(a, z) for a, z in windows(len(words)) if words[a][1] != words[z - 1][1]}
        found += [(at + a, at + z, [x for x, _ in words[a:z]], words[a][1] == words[z - 1][1]) for a, z in spans]
        at += len(words)
    best, families, n_found, until = ("none", ()), set(), 0, -1
    for a, z, w, single in sorted(found, key=lambda x: x[0]):
        h = np.concatenate([grams(memory.of(" ".join(w)), 1), grams(memory.of(" ".join(w)), 2) if len(w) > 1 else np.array([], dtype=np.uint64)]) & np.uint64((1 << BITS) - 1)
        logit = (model.weights[h.astype(np.int64)].astype(np.float64).sum(axis=0) / np.sqrt(len(h)) + model.bias) / model.temperature
        p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        if 1 - p[-1] < LEAST:
            continue
        n_found += a >= until
        until = max(until, z)
        have = set(zip(w, w[1:]))
        names = {k for (k, t), o in zip(named, own) if len(t & have) >= CONFIRM * len(t) and len(o & have) >= CONFIRM * len(o) and o}
        families |= {FAMILIES[k] for k in names}
        for k in sorted(names):
            best = max(best, (FAMILIES[k], (True, single, p[k])), key=lambda x: x[1])
        if not names:
            best = max(best, ("unknown", (False, single, 1 - p[-1])), key=lambda x: x[1])
    return best[0], sorted(families), n_found


def _pairs(template):
    w = WORD.findall(template.lower())
    return zip(w, w[1:])


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = [(10**6 + k, f"a line\n{t}. and on\n\n{t.replace(' under', chr(10) + 'under')}\n" * 2 + "words " * 40 + t) for k, t in enumerate(x for f in FAMILIES for x in statements(f))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*extra, (None, None), (5, "x " * 5000)], "doc_id long, text string"))
    model = train(docs, sample=60)
    assert len(model.bias) == len(CLASSES)
    texts = docs.collect()
    got = sorted((r.doc_id or -1, r.family, r.families, r.n_found) for r in scan_licences(docs, model=model).collect())
    want = sorted((r.doc_id or -1, *brute(model, r.text or "")) for r in texts)
    assert got == want


def test_few_ordinary_stretches_are_scored_and_none_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, words = train(docs, sample=60), Words()
    ordinary = [r.text or "" for r in docs.select("text").collect()]
    stated = [f"a line\n{t}. and on\nWords words Σ\n\n" for f in FAMILIES for t in statements(f)]
    for texts, most in ((ordinary, 0.2), ([*stated, "", "\n", "one", *ordinary], 1)):
        w, first, sizes, of, number, follows = licences._lines(texts, words)
        start, end = licences._stretches(first, sizes, np.repeat(np.arange(len(sizes)), sizes), follows)
        may = licences._possible(model, licences._most(model), w, start, end)
        told = np.flatnonzero(1 - licences._probabilities(model, w, start, end)[:, -1] >= LEAST)
        assert set(told) <= set(may) and len(told) and len(may) <= most * len(start)
        lines = [(k, n) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if WORD.search(line.lower())]
        assert list(zip(of, number)) == lines
    text = "\n".join(stated) + "\n"
    assert all((words.tokens(text, n) == words.tokens(text)).all() for n in (1, 7, 300)) and len(words.tokens("")) == 0
