"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins.  Cyclic boosting visits one feature after the
other and adds a small step of a shallow tree, grown on the binned gradients, to
that feature's lookup table; then pairs of features whose joint tables still
explain the most get two-dimensional tables in the same way.  A score is the sum
of one table entry for each feature and pair.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _training as tr
from ._shared import split_of, table

#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 10_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, LEAST = 48, 12, 240, 120, 6, 0.08, 4, 5

#: Bytes that are packed in one go.
PIECE = 1 << 20

FEATURES = [
    "log_words", "distinct", "top_share", "top3_share", "repeats", "longest_run", "repeated_pairs", "word_length", "length_spread",
    "short", "capitals", "all_caps", "marks", "marked_words", "tailed_words", "digits", "letters", "pipes", "lines", "line_repeats",
    "line_length", "sentence_length", "deflated", "distinct_letters",
]


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text, all zero without words.

    Words are what white space separates, small letters for capitals where they are told apart; lines are stretches of
    words without a line feed between them.  Marks are neither white space nor of words nor common punctuation.
    """
    t = tr.Letters(texts)
    n, m = np.maximum(t.count, 1), len(t.start)
    chars = np.maximum(np.diff(t.ends), 1)
    counts = t.counts()
    words = t.strings(tr.kinds()[1][t.codes], t.start, t.end).dictionary_encode().indices.to_numpy().astype(np.uint64)
    doc = t.doc.astype(np.uint64)
    own = doc << np.uint64(32) | words
    kind = tr.sorted_kinds(own)
    place = np.searchsorted(kind, own)  # the distinct words of each text
    each = np.bincount(place, minlength=len(kind))
    owner = (kind >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((-each, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner, owner)  # owners are in order already
    best = [np.bincount(owner[order][rank < j], each[order][rank < j], t.n) for j in (1, 3)]
    beside = doc[1:] == doc[:-1]
    same = (words[1:] == words[:-1]) & beside
    start, length = tr.runs(words, doc)
    longest = np.zeros(t.n)
    np.maximum.at(longest, t.doc[start[length > 1]], length[length > 1])
    pairs = tr.sorted_kinds(place[:-1][beside].astype(np.uint64) << np.uint64(32) | words[1:][beside])
    pairs = np.bincount(owner[(pairs >> np.uint64(32)).astype(np.int64)], minlength=t.n)
    size = (t.end - t.start).astype(float)
    mean = t.sums(size) / n
    marks = np.flatnonzero(t.bits & (tr.WORD | tr.SPACE | tr.MILD) == 0)
    marked = np.zeros(m, bool)
    marked[t.words_at(marks)] = True
    outside = t.bits & tr.WORD == 0
    last = t.end - 1
    tailed = (size > 1) & outside[last] & outside[np.maximum(last - 1, 0)] if m else np.zeros(0, bool)
    capitals = (size > 1) & (t.word_bits() & (tr.UPPER | tr.LOWER) == tr.UPPER)
    letters = tr.with_bits(counts, tr.LETTER)
    # lines: words of one text with no line feed between them
    feeds = np.searchsorted(np.flatnonzero(t.codes == 10), t.start)
    at, run = tr.runs(feeds, t.doc)
    lines = t.strings(t.codes, t.start[at], t.end[at + run - 1]).dictionary_encode().indices.to_numpy().astype(np.uint64)
    n_lines = np.bincount(t.doc[at], minlength=t.n)
    kinds_of = np.bincount((tr.sorted_kinds(doc[at] << np.uint64(32) | lines) >> np.uint64(32)).astype(np.int64), minlength=t.n)
    stops = tr.with_bits(counts, tr.STOP)
    seen = np.bincount(np.repeat(np.arange(t.n) << 8, np.diff(t.at)) | np.frombuffer(t.raw, np.uint8), minlength=t.n << 8).reshape(t.n, 256) > 0
    packed = np.array([_deflated(t.raw[a:b]) for a, b in zip(t.at[:-1], t.at[1:])])
    x = np.stack([
        np.log1p(t.count), np.bincount(owner, minlength=t.n) / n**0.9, best[0] / n, best[1] / n, np.bincount(t.doc[1:][same], minlength=t.n) / n, np.log1p(longest),
        1 - pairs / np.maximum(t.count - 1, 1), mean, np.sqrt(np.maximum(t.sums(size * size) / n - mean * mean, 0)), t.sums(size <= 3) / n,
        tr.with_bits(counts, tr.UPPER) / np.maximum(letters, 1), t.sums(capitals) / n, t.texts_at(marks) / chars, t.sums(marked) / n, t.sums(tailed) / n,
        tr.with_bits(counts, tr.DIGIT) / chars, letters / chars, t.texts_at(np.flatnonzero(t.codes == 124)) / n, np.log1p(n_lines),
        1 - kinds_of / np.maximum(n_lines, 1), n / np.maximum(n_lines, 1), n / (stops + 1), packed, np.log1p(seen.sum(1)),
    ], 1).reshape(t.n, len(FEATURES))
    x[t.count == 0] = 0
    return x


def _deflated(raw: memoryview) -> float:
    """The size of a text when packed, relative to its own, piece by piece."""
    sizes = [(len(zlib.compress(raw[k : k + PIECE], 1)), len(raw[k : k + PIECE])) for k in range(0, len(raw), PIECE)]
    return sum(a for a, _ in sizes) / max(1, sum(b for _, b in sizes))


class Gam:
    """Lookup tables over binned features and pairs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.coarse = [e[:: max(1, -(-len(e) // COARSE))] for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        w = np.ones(len(y)) if w is None else w
        ones, all_ = float((w * y).sum()), float(w.sum())
        self.base = float(np.log((ones + 1) / (all_ - ones + 1)))
        if not 0 < y.sum() < len(y):
            return
        cells = self._cells(x, self.edges)
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                step = RATE * shallow(np.bincount(cells[j], w * (y - p), len(self.tables[j])), np.bincount(cells[j], w * p * (1 - p), len(self.tables[j])), np.bincount(cells[j], minlength=len(self.tables[j])))
                self.tables[j] += step
                f += step[cells[j]]
        cells = self._cells(x, self.coarse)
        p = 1 / (1 + np.exp(-f))
        gains = sorted(((self._gain(cells, a, b, w * (y - p), w * p * (1 - p)), a, b) for a, b in combinations(range(d), 2)), reverse=True)
        self.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(self.pairs):
                p = 1 / (1 + np.exp(-f))
                step = RATE * self._quarters(cells, a, b, w * (y - p), w * p * (1 - p))
                self.pair_tables[k] += step
                f += step[cells[a], cells[b]]

    @staticmethod
    def _cells(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def _quadrants(self, cells, a, b, g, h):
        """Sums of g, h and rows on the four sides of every pair of cuts."""
        shape = len(self.coarse[a]) + 1, len(self.coarse[b]) + 1
        at = cells[a] * shape[1] + cells[b]
        out = []
        for w in (g, h, None):
            c = np.bincount(at, w, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1)
            low, all_ = c[:-1, :-1], c[-1, -1]
            first, second = c[:-1, -1:], c[-1:, :-1]
            out.append(np.stack([low, first - low, second - low, all_ - first - second + low]))
        return out

    def _best(self, cells, a, b, g, h):
        if not len(self.coarse[a]) or not len(self.coarse[b]):
            return 0.0, 0, 0, np.zeros(4)
        gs, hs, ns = self._quadrants(cells, a, b, g, h)
        gain = np.where(ns >= LEAST, gs * gs / (hs + 1), 0).sum(0)
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[i, j]), i, j, np.where(ns[:, i, j] >= LEAST, gs[:, i, j] / (hs[:, i, j] + 1), 0)

    def _gain(self, cells, a, b, g, h) -> float:
        return self._best(cells, a, b, g, h)[0]

    def _quarters(self, cells, a, b, g, h) -> np.ndarray:
        """A tree of one cut on each feature, as a table."""
        out = np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))
        gain, i, j, (low, first, second, both) = self._best(cells, a, b, g, h)
        if gain:
            out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = low, first, second, both
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: one addition for each table."""
        f = np.full(len(x), self.base)
        for t, c in zip(self.tables, self._cells(x, self.edges)):
            f += t[c]
        cells = self._cells(x, self.coarse)
        for t, (a, b) in zip(self.pair_tables, self.pairs):
            f += t[cells[a], cells[b]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of at most LEAVES leaves over the bins of one feature, as a table of Newton steps."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    leaves = [(0, len(g))]
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(leaves) < LEAVES:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gain = np.where((cn[cut] - cn[a] >= LEAST) & (cn[b] - cn[cut] >= LEAST), value(a, cut) + value(cut, b) - value(a, b), 0)
            i = int(np.argmax(gain))
            best = max(best, (float(gain[i]), k, int(cut[i])))
        if best[0] <= 1e-9:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Gam:
    """A model of labels.quality, learned from the labelled documents that `learnable` admits."""
    sample = tr.labelled(labels, "quality", learnable, per_class)
    _, x, y, w = tr.matrix(tr.feature_rows(tr.with_labels(docs, sample), lambda: features, len(FEATURES)), len(FEATURES))
    return Gam(x, y, w)


def classify(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for every row of docs.

    A null text is scored as empty, all of whose features are zero; a row without doc_id is not held out.  Repeated
    rows stay repeated; other columns are not read.  Without labels of both classes the score is their share.
    """
    return tr.scored(docs, lambda: features, model.score, len(FEATURES), 4, 2, threshold)


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, as they are, that classify() predicts 1 for."""
    return tr.kept(docs, lambda: features, model.score, len(FEATURES), lambda s: s >= threshold)


def op1_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 4) != 2))
