"""Licence statements: a trained paragraph classifier, confirmed by comparison with templates.

Lines are read one by one, and paragraphs (lines up to the next without a word) across their line ends; what has
more than ``SPAN`` words is read in half-overlapping windows. A multinomial
logistic regression over hashed word 1- and 2-grams tells the families, ``unknown`` (licence language of no known
family) and ``none`` apart. It is fitted on varied templates, made-up statements of no family, and paragraphs from
at most ``SAMPLE`` documents; a temperature and a shift of ``none``, fitted on a held-out third, calibrate the probabilities. The
calibrated probability alone tells what is licence language. A family counts only if the stretch holds most word
pairs of one of the family's templates; otherwise it is ``unknown``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, text_of
from .words import LINE_END, WORD, Words, grams

#: The statements by which works name these licences.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "Apache License Version 2.0 January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "artistic": ["Licensed under the Artistic License 2.0", "you may redistribute it and/or modify it under the terms of the Artistic License"],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD License",
        "Released under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Licensed under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "has waived all copyright and related or neighboring rights to this work"],
    "cddl": ["subject to the terms of the Common Development and Distribution License", "Licensed under the CDDL 1.0"],
    "epl": ["Licensed under the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License"],
    "eupl": ["Licensed under the European Union Public Licence, Version 1.2", "Licensed under the EUPL"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the GNU GPL"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License"],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "Licensed under the SIL Open Font License"],
    "psf": ["Licensed under the Python Software Foundation License Version 2", "Distributed under the PSF License Agreement"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "Licensed under the WTFPL, version 2"],
    "zlib": [
        "Licensed under the zlib License",
        "In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ],
}
#: The short identifiers of these licences, without the suffixes of ``SUFFIXES``.
IDENTIFIERS = {
    "agpl": ["AGPL-3.0"], "apache": ["Apache-2.0"], "artistic": ["Artistic-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc0": ["CC0-1.0"], "cddl": ["CDDL-1.0"], "epl": ["EPL-1.0", "EPL-2.0"],
    "eupl": ["EUPL-1.2"], "gpl": ["GPL-2.0", "GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "ofl": ["OFL-1.1"], "psf": ["PSF-2.0"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
}
#: Endings of the identifiers of the GNU licences.
SUFFIXES = ["only", "or-later"]
#: Names of the versions of the Creative Commons licences before the last.
VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported"}


def _short() -> dict[str, list[str]]:
    """Templates by rule: identifiers with their tags, and earlier versions of the Creative Commons licences."""
    out = {f: [] for f in TEMPLATES}
    for f, names in IDENTIFIERS.items():
        ends = ["", *[f"-{x}" for x in SUFFIXES]] if f.endswith("gpl") else [""]
        out[f] += [f"{tag}: {x}{e}" for x in names for tag in ("SPDX-License-Identifier", "License") for e in (ends if tag != "License" else ends[:1])]
    for f, (_, long) in ((f, t) for f, t in TEMPLATES.items() if f.startswith("cc-")):
        out[f] += [f"{tag}: {f.upper()}-4.0" for tag in ("SPDX-License-Identifier", "License")]
        for v, name in VERSIONS.items():
            out[f] += [f"Licensed under {f.upper().replace('CC-', 'CC ')} {v}", long.replace("4.0 International", f"{v} {name}")]
    return out


SHORT = _short()
#: Made-up licence language; NAME stands for a random word.
OTHER = [
    "Licensed under the NAME License, version 1.2", "Released under the NAME Public License", "All rights reserved by NAME, no part may be reproduced without permission",
    "All rights reserved", "This file is subject to the NAME licence agreement", "Use of this work is permitted under the terms of the NAME license", "Copyright NAME, distribution is not permitted",
    "SPDX-License-Identifier: NAME", "SPDX-License-Identifier: LicenseRef-NAME",
]
FAMILIES = list(TEMPLATES)
CLASSES = [*FAMILIES, "unknown", "none"]
#: Documents, chosen by a hash of their id, whose whole texts are the fit's ordinary lines and paragraphs.
SAMPLE = 150
#: Bytes that these have together at most.
SAMPLE_BYTES = 2_000_000
#: Words that are read at a time, and bits of a feature's number.
SPAN, BITS = 24, 18
#: Characters whose words are scored at a time; a longer text is scored by itself.
PART = 1_000_000
#: Stretches whose features are summed at a time.
STEP = 8192
#: Made-up ordinary lines.
MADE = 1000
#: Examples of a statement, and of a template made by rule.
EXAMPLES, FEW = 40, 10
#: Rounds of the fit between looks at all rows, and the error below which a row waits in between.
AGAIN, CERTAIN = 10, 0.02
CONFIRM, LEAST = 0.6, 0.5


def _features(w: np.ndarray) -> np.ndarray:
    """Feature of each word and of each pair that starts there; the last word has no pair."""
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate([grams(w, 1) & mask, (grams(w, 2) & mask) if len(w) > 1 else w[:0]]).astype(np.int64)


def _once(w: np.ndarray) -> np.ndarray:
    """Words without those said again at once, whose weights would add up."""
    return w[np.r_[True, w[1:] != w[:-1]]] if len(w) else w


def statements(family: str) -> list[str]:
    """All templates of a family."""
    return [*TEMPLATES[family], *SHORT[family]]


def _fixed(t: str, memory: Words) -> np.ndarray:
    """Word pairs of a template, without those that hold NAME."""
    return np.unique(np.concatenate([grams(w, 2) for w in map(memory.of, t.split("NAME")) if len(w) > 1]))


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature


def _most(model: Model) -> np.ndarray:
    """Of each feature, the most by which it can raise a class above ``none``."""
    return model.weights[:, :-1].max(axis=1).astype(np.float64) - model.weights[:, -1]


def _possible(model: Model, most: np.ndarray, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Stretches that may be licence language: for the others, a bound on all classes at once leaves ``none`` more than
    1 - LEAST, whatever the classes' own sums are."""
    mask, none = np.uint64((1 << BITS) - 1), np.zeros(1)
    one = np.r_[none, np.cumsum(most[(grams(w, 1) & mask).astype(np.int64)])]
    two = np.r_[none, np.cumsum(most[(grams(w, 2) & mask).astype(np.int64)])] if len(w) > 1 else none
    above = (one[end] - one[start] + two[end - 1] - two[start]) / np.sqrt(2 * (end - start) - 1) + (model.bias[:-1] - model.bias[-1]).max()
    # sum of exp(z - z of none) over the classes is LEAST / (1 - LEAST) at least, so one of them has its share of it
    return np.flatnonzero(above >= model.temperature * np.log(LEAST / (1 - LEAST) / (len(CLASSES) - 1)) - 1e-6)


def _probabilities(model: Model, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class probabilities of stretches of ``w``. ``STEP`` stretches are summed at a time, whose words are ``STEP * SPAN``
    at most, so memory doesn't grow with the text; equal stretches get equal probabilities."""
    mask, out = np.uint64((1 << BITS) - 1), [np.zeros((0, len(CLASSES)))]
    one = (grams(w, 1) & mask).astype(np.int64)
    two = (grams(w, 2) & mask).astype(np.int64) if len(w) > 1 else one[:0]

    def sums(feature: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        first = np.cumsum(n) - n
        return np.add.reduceat(model.weights[feature[np.repeat(a - first, n) + np.arange(n.sum())]], first, axis=0, dtype=np.float64)

    for k in range(0, len(start), STEP):
        a, n = start[k : k + STEP], end[k : k + STEP] - start[k : k + STEP]
        z = sums(one, a, n)
        if (n > 1).any():
            z[n > 1] += sums(two, a[n > 1], n[n > 1] - 1)
        out.append(_softmax((z / np.sqrt(2 * n - 1)[:, None] + model.bias) / model.temperature))
    return np.concatenate(out)


def fit(negatives: list[str], seed: int = 5, rounds: int = 120) -> Model:
    rng = np.random.default_rng(seed)
    memory = Words()
    ordinary = np.array([x for t in negatives for x in t.split()] or ["the", "of", "and"], dtype=object)

    def among(words: list[str]) -> str:
        return " ".join([*rng.choice(ordinary, rng.integers(0, 9)), *words, *rng.choice(ordinary, rng.integers(0, 9))])

    def varied(t: str) -> str:
        return among([w for w in t.split() if rng.random() > 0.06])

    rows = [(varied(t), k) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f] for _ in range(EXAMPLES)]
    rows += [(among([t]), k) for k, f in enumerate(FAMILIES) for t in SHORT[f] for _ in range(FEW)]  # short ones whole, as one word tells little
    rows += [(varied(t.replace("NAME", str(rng.choice(ordinary)))), len(FAMILIES)) for t in OTHER for _ in range(EXAMPLES)]
    pairs = [set(_fixed(t, memory).tolist()) for t in [*(t for f in FAMILIES for t in statements(f)), *OTHER]]
    apart = np.array([w for x in [*TEMPLATES.values(), OTHER] for t in x for w in WORD.findall(t) if w != "NAME"], dtype=object)
    # words of licences out of order and alone, and other words alone
    made = [" ".join(rng.permutation([*rng.choice(apart, rng.integers(1, 4)), *rng.choice(ordinary, rng.integers(0, 9))])) for _ in range(MADE)]
    made += [str(w) for w in [*np.unique(apart), *rng.choice(ordinary, MADE // 4)]]
    parts = sorted({w for x in IDENTIFIERS.values() for t in [*x, *SUFFIXES] for w in WORD.findall(t)})
    made += [among([w]) for w in parts for _ in range(EXAMPLES)] + [w for w in parts for _ in range(EXAMPLES)]
    holders: dict[int, list[int]] = {}  # the templates with a pair
    for k, p in enumerate(pairs):
        for h in p:
            holders.setdefault(h, []).append(k)
    for made_up, t in [*((False, t) for t in negatives), *((True, t) for t in made)]:
        met = [k for h in set(grams(memory.of(t), 2).tolist()) for k in holders.get(h, ())]
        if not any(met.count(k) > 0.4 * len(pairs[k]) for k in set(met)):
            rows.append((t, len(CLASSES) - 1 + made_up))
    x = [_features(_once(memory.of(t))) for t, _ in rows]
    rows, x = [r for r, f in zip(rows, x, strict=True) if len(f)], [f for f in x if len(f)]
    kind = np.array([k for _, k in rows])  # classes, made ordinary lines apart
    y = np.minimum(kind, len(CLASSES) - 1)
    turn = rng.permutation(len(rows))
    held, used = turn[: len(turn) // 3], turn[len(turn) // 3 :]

    def flat(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x[k]) for k in which], dtype=np.int64)
        return np.concatenate([x[k] for k in which]), np.repeat(np.arange(len(which)), n), np.repeat(1 / np.sqrt(n), n)

    def logits(w: np.ndarray, f: np.ndarray, row: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(row, of[f] * v) for of in w]) + bias  # class by class: each row has features

    f, row, v = flat(used)
    known, f = np.unique(f, return_inverse=True)  # the features that the examples have
    own, bias = np.zeros((len(CLASSES), len(known))), np.zeros(len(CLASSES))
    truth = np.eye(len(CLASSES))[y[used]]
    balance = (1 / np.maximum(np.bincount(kind[used]), 1))[kind[used]]  # each kind counts alike
    balance *= len(used) / balance.sum()
    squares = np.full(len(known), 1e-6)
    share = balance[:, None] / len(used)
    for r in range(rounds):
        if r % AGAIN == 0:  # rows that are all but certain wait until the next look at all of them
            live = np.abs(_softmax(logits(own, f, row, v)) - truth).max(axis=1) > CERTAIN
            if not live.any():
                break
            on = live[row]
            f_on, row_on, v_on = f[on], (np.cumsum(live) - 1)[row[on]], v[on]
        d = (_softmax(logits(own, f_on, row_on, v_on)) - truth[live]) * share[live]
        g = np.vstack([np.bincount(f_on, k[row_on] * v_on, len(known)) for k in np.ascontiguousarray(d.T)]) + 1e-5 * own
        squares += (g * g).sum(axis=0)
        own -= 0.5 * g / np.sqrt(squares)
        bias -= 2.0 * d.sum(axis=0)
    weights = np.zeros((len(CLASSES), 1 << BITS))
    weights[:, known] = own
    z = logits(weights, *flat(held)) if len(held) else np.zeros((0, len(CLASSES)))
    none = np.eye(len(CLASSES))[-1]  # classes count alike in the fit: the shift gives ordinary lines their due
    scales = [(t, d) for t in np.geomspace(0.2, 5, 40) for d in np.linspace(0, 4, 17)]
    best, shift = min(scales, key=lambda x: -np.log(_softmax((z + x[1] * none) / x[0])[np.arange(len(held)), y[held]] + 1e-12).sum())
    bias += shift * none
    return Model(np.ascontiguousarray(weights.T, dtype=np.float32), bias, float(best))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(n: int) -> list[tuple[int, int]]:
    """The stretches in which a line of ``n`` words is read."""
    if n <= SPAN:
        return [(0, n)] if n else []
    return [(a, min(a + SPAN, n)) for a in range(0, n - SPAN // 2, SPAN // 2)]


def _read(lines: list[str]) -> list[str]:
    """The lines, and the windows of their paragraphs, as they are scanned."""
    out, paragraph = list(lines), []
    for x in [*lines, ""]:
        words = WORD.findall(x)
        if not words and len(paragraph) > 1:
            flat = [w for p in paragraph for w in p]
            out += [" ".join(flat[a:z]) for a, z in windows(len(flat))]
        paragraph = [*paragraph, words] if words else []
    return out


def _windows(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the ``windows`` of lines of ``n`` words, at least one, that begin at ``first``."""
    half = SPAN // 2
    many = np.where(n <= SPAN, 1, -(-(n - half) // half))
    start = np.repeat(first, many) + half * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return start, np.minimum(start + SPAN, np.repeat(first + n, many))


def _stretches(first: np.ndarray, sizes: np.ndarray, line: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what is read, by start: each line, and each window of a paragraph that crosses a line end.

    ``first`` and ``sizes`` are of lines, ``line`` of words; ``follows`` tells lines that go on with a paragraph.
    """
    head = np.flatnonzero(~follows)
    total = np.add.reduceat(sizes, head)
    short, several = sizes <= SPAN, total > sizes[head]
    a, z = _windows(first[head[several]], total[several])
    across = line[a] != line[z - 1]
    parts = [(first[short], (first + sizes)[short]), _windows(first[~short], sizes[~short]), (a[across], z[across])]
    start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], end[order]


def _lines(texts: Iterable[str], words: Words) -> tuple[np.ndarray, ...]:
    """Words of all texts, without those said again at once in a line; and of each line that has words its first word, its
    number of words, its text, its number in the text, and whether it goes on with the line before."""
    hashes, ends = [], []
    for t in texts:
        h = words.tokens(t)
        hashes += [h, np.array([LINE_END], dtype=np.uint64)]
        ends.append(int((h == LINE_END).sum()) + 1)
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    over = h == np.uint64(LINE_END)
    w, at = h[~over], np.cumsum(over)[~over]
    if len(w):
        keep = np.concatenate([[True], (w[1:] != w[:-1]) | (at[1:] != at[:-1])])
        w, at = w[keep], at[keep]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(w) else at
    sizes, at = np.diff(np.append(first, len(w))), at[first]
    top = np.cumsum(ends) - ends  # the texts' first lines
    of = np.searchsorted(top, at, "right") - 1
    follows = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (of[1:] == of[:-1])])[: len(at)]
    return w, first, sizes, of, at - top[of], follows


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole texts, some ``PART`` characters at a time."""
    for b in batches:
        sizes, a = [len(t) for t in b["text"]], 0
        while a < len(b):
            e, size = a + 1, sizes[a]
            while e < len(b) and size + sizes[e] <= PART:
                size += sizes[e]
                e += 1
            yield b.iloc[a:e]
            a = e


def _scan(model: Model):
    memory = Words()
    pairs = [(k, _fixed(t, memory)) for k, f in enumerate(FAMILIES) for t in statements(f)]
    #: Of each template, the pairs that no template of another family has: they tell GPL from LGPL, and CC BY from CC BY-NC.
    own = [np.setdiff1d(t, np.concatenate([x for j, x in pairs if j != k])) for k, t in pairs]

    holders: dict[int, list[tuple[int, bool]]] = {}  # the templates with a pair, and whether it is their own
    for j, ((_, t), o) in enumerate(zip(pairs, own, strict=True)):
        mine = set(o.tolist())
        for h in t.tolist():
            holders.setdefault(h, []).append((j, h in mine))
    most_of = _most(model)

    def confirmed(g: np.ndarray) -> dict[int, np.ndarray]:
        """Families with most pairs of a template, and most of those that are its own, among ``g``, with that template."""
        out, most, met, met_own = {}, {}, {}, {}
        for h in set(g.tolist()):
            for j, is_own in holders.get(h, ()):
                met[j] = met.get(j, 0) + 1
                met_own[j] = met_own.get(j, 0) + is_own
        for j in sorted(met):
            k, t = pairs[j]
            share = met[j] / len(t)
            if share >= CONFIRM and share > most.get(k, 0) and len(own[j]) and met_own[j] / len(own[j]) >= CONFIRM:
                out[k], most[k] = t, share
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in _parts(batches):
            w, first, sizes, of, number, follows = _lines(b["text"], words)
            best = [("none", 0.0, None, ())] * len(b)
            families, n_found, until = [set() for _ in range(len(b))], [0] * len(b), [-1] * len(b)
            if len(w):
                line = np.repeat(np.arange(len(sizes)), sizes)
                start, end = _stretches(first, sizes, line, follows)
                may = _possible(model, most_of, w, start, end)
                start, end = start[may], end[may]
                p = _probabilities(model, w, start, end)
                for s in np.flatnonzero(1 - p[:, -1] >= LEAST):  # licence language of any kind
                    doc = of[line[start[s]]]
                    if start[s] >= until[doc]:
                        n_found[doc] += 1
                    until[doc] = max(until[doc], end[s])
                    single = line[start[s]] == line[end[s] - 1]
                    g = grams(w[start[s] : end[s]], 2)
                    names = confirmed(g)
                    for k, t in names.items():
                        families[doc].add(FAMILIES[k])
                        at = start[s] + np.flatnonzero(np.isin(g, t))
                        best[doc] = max(best[doc], (FAMILIES[k], float(p[s, k]), int(number[np.bincount(line[at]).argmax()]), (True, single, float(p[s, k]))), key=lambda x: x[3])
                    if not names:
                        best[doc] = max(best[doc], ("unknown", float(1 - p[s, -1]), int(number[line[start[s]]]), (False, single, float(1 - p[s, -1]))), key=lambda x: x[3])
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "family": [x[0] for x in best], "probability": [x[1] for x in best],
                "n_found": n_found, "line_no": pd.array([x[2] for x in best], dtype="Int64"), "families": [sorted(x) for x in families],
            })

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model whose ordinary lines and paragraphs are the whole texts of ``sample`` documents, of ``sample_bytes`` bytes
    together at most, chosen by a hash of their id; a text that doesn't fit any more is left out by itself."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    turn = texts.select("doc_id", "h", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)
    chosen, room = [], sample_bytes
    for r in turn.collect():  # ``sample`` small rows
        if r["size"] <= room:
            chosen.append((r["doc_id"], r["h"]))
            room -= r["size"]
    keys = docs.sparkSession.createDataFrame(chosen, "id long, hash long").distinct()
    got = texts.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).select("doc_id", "h", "text").dropDuplicates(["doc_id", "h"])
    return fit([x for r in got.orderBy(F.xxhash64("doc_id"), "doc_id", "h").collect() for x in _read(r["text"].split("\n"))])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, family (``none``, ``unknown`` or a family: the most probable, confirmed ones first,
    then those within a line, and the first in the text of equally probable ones), its probability, n_found (separate
    stretches of licence language), line_no (0-based line of the family) and families (all confirmed ones, sorted).

    Null text counts as empty and gives ``none``; repeated rows give repeated rows; a null id is kept; an empty
    table gives an empty result; further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    model = model or train(docs, id_col, text_col, sample)
    with arrow_rows(docs.sparkSession, 500):
        return cut(texts.mapInPandas(_scan(model), "doc_id long, family string, probability double, n_found long, line_no long, families array<string>"))
