"""Quality by a linear-chain conditional random field over the lines of a document.

Every line has numeric features of its own and of its two neighbours. A two-state chain (bad, good) with learnt
emission weights and transitions gives each line its marginal probability by forward and backward sums; the
marginals, weighted by line length, make the document's mean, which a logistic fit on the training documents
turns into a score. Only the text is an input.

The fit uses at most ``SAMPLE`` labelled documents of ``SAMPLE_BYTES`` together, chosen by a hash of their id;
scoring runs in map tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, text_of

#: Labelled documents that the fit uses at most.
SAMPLE = 4000
#: Bytes that these have together at most; in the order of the hash, a text that doesn't fit any more is left out.
SAMPLE_BYTES = 8_000_000
#: In the fit, longer documents are several chains of so many lines, all of which count.
CHAIN = 256
LEAST = 0.3
SLICE = 1_000_000

LETTER, UPPER, DIGIT, SPACE, PIPE, SYMBOL, STOP, OTHER = range(8)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = LETTER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[ord("|")] = PIPE
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\/=+_"]] = SYMBOL
_CLASS[[ord(c) for c in ".,;:!?"]] = STOP
N_OWN = 16


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths in bytes, and the number of lines of each text."""
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    data = np.frombuffer(("\n".join(texts) + "\n").encode(), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    kind = _CLASS[data]
    line = np.repeat(np.arange(len(ends)), length + 1)
    counts = np.bincount(line * 8 + kind, minlength=8 * len(ends)).reshape(-1, 8).astype(np.float64)
    counts[:, OTHER] -= 1  # the line end
    share = counts / np.maximum(length, 1)[:, None]
    gap = kind == SPACE
    begins = ~gap & np.r_[True, gap[:-1] | (data[:-1] == 10)] & (data != 10)
    words = np.bincount(line[begins], minlength=len(ends))
    at = np.flatnonzero(begins)
    word_end = np.flatnonzero((gap | (data == 10)) & ~np.r_[True, gap[:-1] | (data[:-1] == 10)])
    short = np.bincount(line[at], (word_end - at <= 3).astype(float), minlength=len(ends))
    marked = np.bincount(line[at], (kind[word_end - 1] == SYMBOL).astype(float), minlength=len(ends))
    again = np.fromiter((c[x] > 1 and x != "" for x_lines in lines for c in (Counter(x_lines),) for x in x_lines), dtype=np.float64, count=len(ends))
    w = np.maximum(words, 1)
    echo, unlike = np.zeros(len(ends)), np.ones(len(ends))
    for k, x in enumerate(y for x_lines in lines for y in x_lines):
        if words[k] > 1:
            own_words = x.split()
            if len(own_words) > 1:
                echo[k] = sum(map(eq, own_words, own_words[1:])) / len(own_words)
                unlike[k] = len(set(own_words)) / len(own_words)
    own = np.column_stack([
        np.log1p(length), share[:, LETTER], share[:, UPPER] * 5, share[:, DIGIT] * 5, share[:, SPACE] * 3, np.minimum(share[:, PIPE] * 20, 3),
        np.minimum(share[:, SYMBOL] * 20, 3), share[:, STOP] * 10, share[:, OTHER] * 5, short / w, marked / w, np.minimum(length / w / 10, 3), again, (length == 0) * 1.0, np.minimum(echo * 8, 3), unlike,
    ])
    return own, length, n_lines


def chain_features(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of each line with those of the lines before and after it, and whether there are such lines."""
    first = np.r_[0, np.cumsum(n_lines)[:-1]]
    has_before = np.ones(len(own))
    has_before[first] = 0
    has_after = np.r_[has_before[1:], 0.0]
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]) * has_before[:, None]
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))]) * has_after[:, None]
    return np.column_stack([own, before, after, has_before, has_after, np.ones(len(own))])


def _lattice(n_lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each position t: the documents with more than t lines (longest first), and their line indices."""
    first = np.r_[0, np.cumsum(n_lines)[:-1]]
    order = np.argsort(-n_lines, kind="stable")
    sizes = n_lines[order]
    for t in range(int(n_lines.max(initial=0))):
        live = order[: np.searchsorted(-sizes, -t, side="left")]
        yield live, first[live] + t


def forward_backward(emission: np.ndarray, transition: np.ndarray, n_lines: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of state 1 of each line, expected transitions (2 x 2, summed over texts by ``weight``) and
    log partition of each text.

    ``emission`` is the score of state 1 against state 0; ``transition`` holds log potentials.
    """
    steps = list(_lattice(n_lines))
    n = len(emission)
    e = np.column_stack([np.zeros(n), emission])
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    log_z = np.zeros(len(n_lines))
    t00, t01, t10, t11 = transition.ravel()
    for t, (_, at) in enumerate(steps):
        if t == 0:
            a[at] = e[at]
        else:
            p = a[at - 1]
            a[at, 0] = np.logaddexp(p[:, 0] + t00, p[:, 1] + t10) + e[at, 0]
            a[at, 1] = np.logaddexp(p[:, 0] + t01, p[:, 1] + t11) + e[at, 1]
    last = np.cumsum(n_lines) - 1
    log_z = np.logaddexp(a[last, 0], a[last, 1])
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t][1]
        q = b[at] + e[at]
        b[at - 1, 0] = np.logaddexp(q[:, 0] + t00, q[:, 1] + t01)
        b[at - 1, 1] = np.logaddexp(q[:, 0] + t10, q[:, 1] + t11)
    doc_z = np.repeat(log_z, n_lines)
    good = np.exp(np.minimum(a[:, 1] + b[:, 1] - doc_z, 0))
    inner = np.ones(n, dtype=bool)
    inner[np.r_[0, np.cumsum(n_lines)[:-1]]] = False
    i = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    w = np.ones(len(i)) if weight is None else np.repeat(weight, n_lines)[i]
    for x in range(2):
        for y in range(2):
            pair[x, y] = (np.exp(a[i - 1, x] + transition[x, y] + e[i, y] + b[i, y] - doc_z[i]) * w).sum()
    return good, pair, log_z


@dataclass
class Model:
    weights: np.ndarray
    transition: np.ndarray
    scale: float
    shift: float


def _means(good: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean of each document's marginals; a document without letters counts its lines alike."""
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    weight = length + 1e-3
    return np.bincount(doc, good * weight, len(n_lines)) / np.bincount(doc, weight, len(n_lines))


def chains(n_lines: np.ndarray, longest: int = CHAIN) -> np.ndarray:
    """Lengths of the chains that documents of ``n_lines`` lines are cut into."""
    return np.concatenate([np.r_[np.full(n // longest, longest), [n % longest] if n % longest else []].astype(np.int64) for n in n_lines])


def objective(p: np.ndarray, x: np.ndarray, y: np.ndarray, n_lines: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Loss and its gradient: minus the weighted log likelihood of chains whose lines all have the chain's label ``y``,
    plus half the penalty times the squares. The last four of ``p`` are the transitions."""
    transition = p[-4:].reshape(2, 2)
    emission = x @ p[:-4]
    good, pair, log_z = forward_backward(emission, transition, n_lines, weight)
    chain = np.repeat(np.arange(len(n_lines)), n_lines)
    steps = n_lines - 1
    own = y * (np.bincount(chain, emission, len(n_lines)) + steps * transition[1, 1]) + (1 - y) * steps * transition[0, 0]
    held = np.diag([(weight * steps * (1 - y)).sum(), (weight * steps * y).sum()])
    loss = -(weight * (own - log_z)).sum() + penalty / 2 * (p * p).sum()
    g = np.concatenate([x.T @ ((good - y[chain]) * weight[chain]), (pair - held).ravel()]) + penalty * p
    return float(loss), g


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, rate: float = 0.08, penalty: float = 1e-3) -> Model:
    """Maximum conditional likelihood when every line takes its document's label, by Adam over all documents."""
    if len(texts) == 0:
        return Model(np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), 1.0, 0.0)
    # slice by slice, for the features of a line take some twenty times its bytes while they are made
    own, length, n_lines = (np.concatenate(v) for v in zip(*map(line_features, _slices(texts)), strict=True))
    x = chain_features(own, n_lines)
    del own
    parts = chains(n_lines)
    n_parts = -(-n_lines // CHAIN)
    y = np.repeat(labels, n_parts).astype(float)
    weight = np.repeat(1.0 / n_lines, n_parts) / len(texts)  # long documents count as much as short ones
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        _, g = objective(p, x, y, parts, weight, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(p[:-4], p[-4:].reshape(2, 2), 1.0, 0.0)
    good, _, _ = forward_backward(x @ model.weights, model.transition, n_lines)
    z = _logit(_means(good, length, n_lines))
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the two-parameter logistic fit
        q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        r, s = q - labels, q * (1 - q) + 1e-6
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-2]])
        d = np.linalg.solve(h, np.array([(r * z).sum() + 1e-2 * (scale - 1), r.sum()]))
        scale, shift = float(np.clip(scale - d[0], 0.01, 10)), float(np.clip(shift - d[1], -20, 20))
    return Model(model.weights, model.transition, scale, shift)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts, some ``SLICE`` characters at a time."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE):
            size += len(texts[b])
            b += 1
        yield texts[a:b]
        a = b


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of all texts, worked out slice by slice."""
    return np.concatenate([_score(model, some) for some in _slices(texts)]) if texts else np.zeros(0)


def _score(model: Model, texts: list[str]) -> np.ndarray:
    own, length, n_lines = line_features(texts)
    good, _, _ = forward_backward(chain_features(own, n_lines) @ model.weights, model.transition, n_lines)
    z = model.scale * _logit(_means(good, length, n_lines)) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _is_held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fold, chosen by a hash of their id, of
    at most ``sample_bytes`` bytes together."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    ids = ids.where(~_is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h")).join(F.broadcast(ids), "doc_id")
    turn = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample)  # at most ``sample`` small rows
    chosen, room = [], sample_bytes
    for r in turn.collect():
        if r["size"] <= room:  # a text that doesn't fit is left out by itself
            chosen.append((r["doc_id"], r["h"], r["quality"]))
            room -= r["size"]
    spark = docs.sparkSession
    keys = spark.createDataFrame(chosen, "doc_id long, h long, quality int").dropDuplicates(["doc_id", "h"])
    got = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).orderBy(F.xxhash64("doc_id"), "doc_id", "h").toPandas()
    return fit(got["text"].tolist(), got["quality"].to_numpy())


def _texts(b: pd.Series) -> list[str]:
    return ["" if t is None else str(t) for t in b]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; further columns of ``docs`` are ignored.

    Null text counts as empty and is scored as one empty line. Repeated rows give repeated rows and equal texts equal
    scores, a null id is kept, an empty table gives an empty result, and without labels every score is 0.5. A score
    of exactly the limit counts as good. Lines end at ``\\n``. Where labels of one id differ, the higher counts.
    """
    model = train(docs, labels, id_col, text_col, sample, sample_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": score(model, _texts(b["text"]))})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, 1000):
        out = cut(texts.mapInPandas(run, "doc_id long, score double"))
    return out.select("doc_id", _is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= LEAST, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose score reaches the limit, with all their columns as they were.

    Rows are read, scored and passed on in one Arrow pass, so that neither ids nor column names matter: null and
    repeated ids and any further columns are kept; null text is scored as empty and stays null.
    """
    model = train(docs, labels, id_col, text_col, sample, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 500):
                b = whole.slice(a, 500)
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array(score(model, ["" if t is None else str(t) for t in texts]) >= LEAST))

    return docs.mapInArrow(run, docs.schema)
