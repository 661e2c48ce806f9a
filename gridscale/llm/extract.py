"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between starts and ends of block elements, with
character references decoded and white space turned into single spaces. Every block has a vector of its own: the sum of
learnt vectors of its tag path (tags, classes, ids and roles of its ancestors, hashed), the mean of those of its words, hashed, and a
few figures. A bidirectional LSTM reads the vectors of the whole page, so that each block is judged with all others in
view, and a logistic unit labels it main text or not.

The labeller is trained here, in numpy, on ``PAGES`` made pages (``pagemaker``), whose labels are known. Buckets of names
and words that few of their blocks hold have the vector zero, so unknown ones say nothing. Pages are labelled in map
tasks, several at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pagemaker import made_pages

#: Made pages that the fit sees, and how often.
PAGES, ROUNDS = 900, 12
BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 1 << 16, 20, 12, 20
#: Blocks of the made pages that must hold a bucket for it to have a vector; all others are zero.
HELD_BY = 20
#: Share of the blocks whose words are left out in a step of the fit, so that paths and context count as well.
DROPPED = 0.3
#: Elements of a path that are looked at: the outermost and the innermost.
OUTER, INNER = 8, 24
#: Characters of html, and blocks times pages, that are worked at a time.
SLICE, CELLS = 4_000_000, 60_000

# Fixed values of HTML: elements without content, elements whose content is no markup, elements within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What a start tag ends, if it is open and nothing of the second list stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-zà-ÿ]+|[A-Z][a-z]*|[^\W\d_]+")
WORD = re.compile(r"[^\W\d_]+|©")
END = frozenset(".!?…:;,")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    at: int


def _named(tag: str, attributes: str) -> str:
    """An element as its tag and the parts of its names."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return tag
    names = []
    for key, a, b, c in NAMED.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            names += [x.lower() for x in PART.findall(value)[:12]]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            names.append("hidden")
    return " ".join([tag, *names])


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with their tag path, the number of characters within links, and their place."""
    out: list[Block] = []
    tags: list[str] = []
    names: list[str] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    state: list = [0, -1, ()]  # characters within links, place and path of the first character

    def close() -> None:
        if text:
            told = " ".join("".join(text).split())
            if told:
                out.append(Block(state[2], told, state[0], state[1]))
            text.clear()
        state[:] = 0, -1, ()

    def pop(to: int) -> None:
        for t in tags[to:]:
            opened[t] -= 1
        del tags[to:], names[to:]

    def say(a: int, b: int) -> None:
        if a < b:
            x = entities.unescape(page[a:b])
            text.append(x)
            if state[1] < 0 and not x.isspace():
                state[1] = a
                state[2] = tuple(names) if len(names) <= OUTER + INNER else (*names[:OUTER], *names[-INNER:])
            if opened.get("a"):
                state[0] += len(x.strip())

    pos = 0
    while (m := TOKEN.search(page, pos)) is not None:
        say(pos, m.start())
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                close()
            if opened.get(tag):
                pop(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = end.start() if end else len(page)
            if tag not in INLINE and tag != "title":
                close()
            continue
        if tag == "br":
            text.append("\n")
        if tag not in INLINE:
            close()
            ends, within = ENDS.get(tag, (None, None))
            if ends is None:
                ends, within = {"p"}, {"button", "td", "th", "table", "object"}
            for k in range(len(tags) - 1, max(len(tags) - 1 - INNER, -1), -1):
                if tags[k] in within:
                    break
                if tags[k] in ends:
                    pop(k)
                    if tag != "tr":
                        break
        if tag not in VOID and not m[3].endswith("/"):
            tags.append(tag)
            names.append(_named(tag, m[3]))
            opened[tag] = opened.get(tag, 0) + 1
    say(pos, len(page))
    close()
    return out


class Hashes:
    """Bucket numbers of path elements and words, remembered up to a bound."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], list[int]] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            inner = path[-1].split(" ")[0] if path else ""
            said = {f"leaf {inner}", *(f"{'tag' if k == 0 else 'name'} {x}" for e in path for k, x in enumerate(e.split(" ")))}
            got = self.paths[path] = sorted(crc32(x.encode()) % BUCKETS for x in said)
        return got

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > 200_000:
                self.words.clear()
            got = self.words[word] = crc32(word.encode()) % BUCKETS
        return got


@dataclass
class Inputs:
    """Blocks of several pages as bags: buckets, the block of each, and figures of the blocks."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    figures: np.ndarray
    lengths: np.ndarray


FIGURES = 8


def inputs(pages: list[list[Block]], hashes: Hashes) -> Inputs:
    path, path_n, word, word_n, figures = [], [], [], [], []
    for page in pages:
        for b in page:
            p = hashes.path(b.path)
            w = [hashes.word(x) for x in WORD.findall(b.text.lower())]
            path += p
            path_n.append(len(p))
            word += w
            word_n.append(len(w))
            n = len(b.text)
            stops = b.text.count(". ") + b.text.count(", ") + (b.text[-1] in END)
            figures.append((np.log1p(n) / 5, min(b.linked / n, 1), np.log1p(len(w)) / 4, b.text[-1] in END, min(5 * stops / (len(w) + 1), 1), b.text[0].isupper(), 1.0 if n < 25 else 0.0, 1.0))
    of = lambda n: np.repeat(np.arange(len(n)), n)
    return Inputs(np.array(path, dtype=np.int64), of(path_n), np.array(word, dtype=np.int64), of(word_n), np.array(figures, dtype=np.float32).reshape(-1, FIGURES), np.array([len(p) for p in pages]))


def _bags(table: np.ndarray, bucket: np.ndarray, of: np.ndarray, n: int, mean: bool) -> np.ndarray:
    """Sums or means of rows of ``table`` for each block; zero for a block without any."""
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    if len(bucket):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        step = 200_000
        for a in range(0, len(starts), step):
            s = starts[a : a + step]
            b = starts[a + step] if a + step < len(starts) else len(bucket)
            sums = np.add.reduceat(table[bucket[s[0] : b]], s - s[0], axis=0)
            out[of[s]] = sums / np.diff(np.r_[s, b])[:, None] if mean else sums
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """``path`` and ``word`` hold the vectors of the buckets in ``path_row`` and ``word_row``, row 0 is zero; ``cells`` the
    weights of the gates of both directions."""

    path_row: np.ndarray
    word_row: np.ndarray
    path: np.ndarray
    word: np.ndarray
    cells: np.ndarray
    out: np.ndarray

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.path, self.word, self.cells, self.out]

    def vectors(self, x: Inputs) -> np.ndarray:
        n = len(x.figures)
        known = self.path_row[x.path] > 0
        return np.hstack([_bags(self.path, self.path_row[x.path[known]], x.path_of[known], n, False), _bags(self.word, self.word_row[x.word], x.word_of, n, True), x.figures])

    def label(self, pages: list[list[Block]], hashes: Hashes) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        x = inputs(pages, hashes)
        v, ends = self.vectors(x), np.r_[0, np.cumsum(x.lengths)]
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = np.argsort(x.lengths, kind="stable")
        a = int((x.lengths == 0).sum())
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * x.lengths[order[b]] <= CELLS:
                b += 1
            some = order[a:b]
            padded, there = padded_rows([v[ends[k] : ends[k + 1]] for k in some])
            p = _sigmoid(self.logits(padded, there))
            for i, k in enumerate(some):
                out[k] = p[: x.lengths[k], i]
            a = b
        return out

    def logits(self, x: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = lstm(np.stack([x, x[::-1]], axis=1), np.stack([there, there[::-1]], axis=1), self.cells, keep)
        both = np.concatenate([h[:, 0], h[::-1, 1], x], axis=2)
        if keep is not None:
            keep.append(both)
        return both @ self.out


def padded_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, dim) and which of the steps are there."""
    n = max(map(len, rows))
    x = np.zeros((n, len(rows), rows[0].shape[1]), dtype=np.float32)
    there = np.zeros((n, len(rows), 1), dtype=np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i], there[: len(r), i] = r, 1
    return x, there


def lstm(x: np.ndarray, there: np.ndarray, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of all steps of both directions, (steps, 2, pages, HIDDEN), from x, (steps, 2, pages, dim); a step
    that isn't there leaves the state as it was."""
    steps, _, n, dim = x.shape
    h = c = np.zeros((2, n, HIDDEN), dtype=np.float32)
    own = np.matmul(x, weights[:, :dim])
    own[..., : 3 * HIDDEN] *= 0.5
    again = weights[:, dim:].copy()
    again[..., : 3 * HIDDEN] *= 0.5
    out = np.zeros((steps, 2, n, HIDDEN), dtype=np.float32)
    saved = []
    for t in range(steps):
        z = np.tanh(own[t] + np.matmul(h, again))
        gates = 0.5 + 0.5 * z[..., : 3 * HIDDEN]
        i, f, o, g = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :], z[..., 3 * HIDDEN :]
        new = f * c + i * g
        y = np.tanh(new)
        if keep is not None:
            saved.append((i, f, o, g, c, y, h))
        m = there[t]
        c = c + m * (new - c)
        h = h + m * (o * y - h)
        out[t] = h
    if keep is not None:
        keep.append(saved)
    return out


def lstm_back(dout: np.ndarray, x: np.ndarray, there: np.ndarray, weights: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and the weights from those of the hidden states."""
    steps, _, n, dim = x.shape
    dz_all = np.zeros((steps, 2, n, 4 * HIDDEN), dtype=np.float32)
    dh = dc = np.zeros((2, n, HIDDEN), dtype=np.float32)
    back = weights[:, dim:].transpose(0, 2, 1).copy()
    for t in reversed(range(steps)):
        i, f, o, g, c, y, _ = saved[t]
        m = there[t]
        dh = dh + dout[t]
        on = m * dh
        dnew = m * dc + on * o * (1 - y * y)
        dz = dz_all[t]
        dz[..., :HIDDEN] = dnew * g * i * (1 - i)
        dz[..., HIDDEN : 2 * HIDDEN] = dnew * c * f * (1 - f)
        dz[..., 2 * HIDDEN : 3 * HIDDEN] = on * y * o * (1 - o)
        dz[..., 3 * HIDDEN :] = dnew * i * (1 - g * g)
        dc = dnew * f + dc - m * dc
        dh = np.matmul(dz, back) + dh - on
    before = np.stack([k[6] for k in saved])
    flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, steps * n, -1)
    dz = flat(dz_all)
    dw = np.concatenate([np.matmul(flat(a).transpose(0, 2, 1), dz) for a in (x, before)], axis=1)
    return np.matmul(dz_all, weights[:, :dim].transpose(0, 2, 1)), dw


def gradient(model: Labeller, x: Inputs, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of the blocks and its gradients for the arrays of the model."""
    v, ends = model.vectors(x), np.r_[0, np.cumsum(x.lengths)]
    rows = [v[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    padded, there = padded_rows(rows)
    target, _ = padded_rows([y[a:b, None] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    keep: list = []
    z = model.logits(padded, there, keep)[:, :, None]
    p, m = _sigmoid(z), there / len(y)
    loss = float((m * (np.logaddexp(0, z) - target * z)).sum())
    dz = (p - target) * m
    saved, both = keep
    d_out = (both * dz).sum(axis=(0, 1))
    dboth = dz * model.out
    dh = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN : 2 * HIDDEN]], axis=1)
    dx, d_cells = lstm_back(dh, np.stack([padded, padded[::-1]], axis=1), np.stack([there, there[::-1]], axis=1), model.cells, saved)
    dx = dx[:, 0] + dx[::-1, 1] + dboth[:, :, 2 * HIDDEN :]
    dv = np.vstack([dx[: n, k] for k, n in enumerate(x.lengths)])
    grads = []
    known = model.path_row[x.path] > 0
    for table, row, of, a in ((model.path, model.path_row[x.path[known]], x.path_of[known], 0), (model.word, model.word_row[x.word], x.word_of, PATH_DIM)):
        d = table.shape[1]
        g = dv[:, a : a + d]
        if a:
            g = g / np.maximum(np.bincount(of, minlength=len(dv)), 1)[:, None]
        row, of = row[row > 0], of[row > 0]
        grads.append(np.stack([np.bincount(row, weights=g[of, j], minlength=len(table)) for j in range(d)], axis=1).astype(np.float32))
    return loss, [*grads, d_cells, d_out]


def labelled(parts: list[tuple[str, int | None]]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a made page and their labels, which follow the part that a block begins in."""
    starts = np.r_[0, np.cumsum([len(h) for h, _ in parts])]
    found = blocks("".join(h for h, _ in parts))
    part = np.searchsorted(starts, [b.at for b in found], side="right") - 1
    return found, np.array([parts[k][1] or 0 for k in part], dtype=np.float32)


@lru_cache(maxsize=4)
def fit(pages: int = PAGES, rounds: int = ROUNDS, seed: int = 0, batch: int = 30, rate: float = 0.01) -> Labeller:
    """A labeller from ``pages`` made pages; fitted once in a process."""
    rng = np.random.default_rng(seed)
    dim = PATH_DIM + WORD_DIM + FIGURES
    make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    hashes = Hashes()
    made = [x for x in (labelled(p) for p in made_pages(pages, seed)) if x[0]]
    every = inputs([x[0] for x in made], hashes)
    rows = []
    for bucket, of in ((every.path, every.path_of), (every.word, every.word_of)):
        held = np.bincount(np.unique(of * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS) >= HELD_BY
        rows.append(np.where(held, np.cumsum(held), 0).astype(np.int32))
    model = Labeller(*rows, np.zeros((rows[0].max() + 1, PATH_DIM), np.float32), np.zeros((rows[1].max() + 1, WORD_DIM), np.float32), np.stack([make(dim + HIDDEN, 4 * HIDDEN) for _ in range(2)]), make(2 * HIDDEN + dim))
    arrays = model.arrays
    m, v, step = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays], 0
    for r in range(rounds):
        order = rng.permutation(len(made))
        order = np.concatenate([chunk[np.argsort([len(made[k][0]) for k in chunk])] for chunk in np.array_split(order, max(len(order) // (batch * 4), 1))])
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            some = [made[k] for k in groups[g]]
            x = inputs([s[0] for s in some], hashes)
            told = (rng.random(len(x.figures)) > DROPPED)[x.word_of]
            x.word, x.word_of = x.word[told], x.word_of[told]
            _, grads = gradient(model, x, np.concatenate([s[1] for s in some]))
            step += 1
            now = rate * (1 - r / rounds)
            for k, (a, d) in enumerate(zip(arrays, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                a -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str], model: Labeller, hashes: Hashes) -> list[str]:
    found = [blocks(p) for p in pages]
    return [" ".join(b.text for b, p in zip(bs, ps, strict=True) if p >= 0.5) for bs, ps in zip(found, model.label(found, hashes), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (the main text, empty if there is none) and n_chars, its code points.

    Null html counts as empty; null and repeated ids, null urls and repeated rows are kept; an empty table gives an empty
    result; further columns are ignored. Without a ``model``, the standard one is fitted, once in a process.
    """
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            sizes = b.column(3).to_pylist()
            a = 0
            while a < len(sizes):
                e, size = a + 1, sizes[a]
                while e < len(sizes) and size + sizes[e] <= SLICE:
                    size += sizes[e]
                    e += 1
                some = b.slice(a, e - a)
                texts = main_texts(some.column(2).to_pylist(), model, hashes)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                a = e

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return own.withColumn("size", F.length("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
