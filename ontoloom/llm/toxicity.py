"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that occur in far more toxic
than other documents of the sample.  Features tell how densely a text uses it,
plainly or disguised (digits and signs for letters, drawn-out or spaced letters),
how close to a word of the second person, and how a text uses capitals and
punctuation.  Training features of one half of the sample use the lexicon of
the other half, so the trees see lexicon hits as they will be on new texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _training as tr
from ._shared import split_of, stash, table

#: Labelled rows of each class that the model is fitted on, at most, and entries of the lexicon, at most.
PER_CLASS, ENTRIES = 10_000, 4096
TREES, DEPTH, RATE, BINS, LEAST = 120, 3, 0.1, 64, 8
#: Words from a hit to a word of the second person, at most.
NEAR = 6

#: Words of the second person in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te ti toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer eure tú usted ustedes tus vosotros os".split()
)
#: Signs that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})

#: Signs that may stand between letters.
SIGNS = "@$!|€*#.-_"
_SIGNS = np.zeros(tr.POINTS, bool)
_SIGNS[[ord(c) for c in SIGNS]] = True

_LETTERS = re.compile(r"[^\W\d_]+")
_DRAWN = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[^\W\d_][\d@$!|€*#.\-_]+[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?!\S)")
STEMS = (4, 5, 6)

FEATURES = [
    "log_words", "hits", "hit_share", "kinds", "strongest", "strength", "stem_hits", "stem_share", "stem_strength", "near_second_person",
    "second_person", "capitals", "all_caps", "marks", "exclamations", "disguised_words", "disguised_hits", "spaced_hits", "drawn_out", "word_length",
]


def terms(word: str) -> list[str]:
    """What the lexicon may know a lower-case word by: itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def bare_of(token: str) -> str:
    """The letters of a token as written, lower case."""
    return "".join(_LETTERS.findall(token)).lower()


def undisguised(token: str) -> str:
    """The letters that a token stands for: signs read as letters, drawn-out letters once."""
    return _DRAWN.sub(r"\1", bare_of(token.strip(".,;:!?\"'()").translate(DISGUISES)))


def spelt(word: str) -> bytes:
    """A word as Letters.strings() gives it."""
    return word.encode("utf-32-le")


def bare_words(t: tr.Letters) -> pa.DictionaryArray:
    """The letters of each word, small, as binary of four bytes each."""
    return t.strings(tr.kinds()[1][t.codes], t.start, t.end, t.bits & tr.LETTER > 0).dictionary_encode()


def beginning(words: pa.Array, k: int) -> pa.Array:
    """The first k letters of each word."""
    return pa.compute.binary_slice(words, 0, 4 * k)


class Features:
    """Features of texts under a lexicon {term: log odds}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.tables = []  # for words and each length of beginnings: (terms, log odds and 0 for others)
        for k in (0, *STEMS):
            own = {t: v for t, v in lexicon.items() if (t.endswith("*") and len(t) == k + 1) == bool(k) and (k or not t.endswith("*"))}
            self.tables.append((pa.array([spelt(t.rstrip("*")) for t in own], pa.large_binary()), np.array([*own.values(), 0.0])))
        self.second = pa.array([spelt(w) for w in sorted(SECOND_PERSON)], pa.large_binary())

    def _odds(self, words: pa.Array, table: int) -> np.ndarray:
        terms, odds = self.tables[table]
        at = pa.compute.index_in(words, terms).fill_null(len(odds) - 1).to_numpy(zero_copy_only=False)
        return odds[at]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        t = tr.Letters(texts)
        n, m = np.maximum(t.count, 1), len(t.start)
        code, outer = t.codes, np.zeros(len(t.codes) + 1, bool)
        outer[t.ends] = True  # a text starts here
        bare = bare_words(t)
        of, kinds_ = bare.indices.to_numpy().astype(np.int64), bare.dictionary
        size = pa.compute.binary_length(kinds_).to_numpy(zero_copy_only=False) // 4
        own = self._odds(kinds_, 0)
        stem = np.zeros(len(size))
        for j, length in enumerate(STEMS, 1):
            stem = np.maximum(stem, np.where(size > length, self._odds(beginning(kinds_, length), j), 0))
        own, stem = own[of], stem[of]
        second = pa.compute.is_in(kinds_, self.second).to_numpy(zero_copy_only=False).astype(bool)[of]

        # disguises: only words with signs between letters, or three of a kind, are looked at one by one
        sign = _SIGNS[code] | (t.bits & tr.DIGIT > 0)
        letter = t.bits & tr.LETTER > 0
        a = np.flatnonzero(sign & ~np.insert(sign[:-1] & ~outer[1:-1], 0, False)[: len(sign)])
        b = np.flatnonzero(sign & ~np.append(sign[1:] & ~outer[1:-1], False)[: len(sign)])
        fits = (a > 0) & (b + 1 < len(code))
        a, b = a[fits], b[fits]
        a = a[letter[a - 1] & letter[b + 1] & ~outer[a] & ~outer[b + 1]]
        thrice = np.zeros(len(code), bool)
        thrice[2:] = (t.full[2:] == t.full[1:-1]) & (t.full[1:-1] == t.full[:-2]) & ~outer[2:-1] & ~outer[1:-2] & (code[2:] != 10)
        odd, hidden = np.zeros(m, bool), np.zeros(m)
        for w in np.union1d(t.words_at(a), t.words_at(np.flatnonzero(thrice & (t.bits & tr.SPACE == 0)))).tolist():
            token = t.full[t.start[w] : t.end[w]].tobytes().decode("utf-32-le")
            plain = undisguised(token)
            if plain != bare_of(token) and (_INNER.search(token) or _DRAWN.search(token)):
                odd[w] = True
                if not own[w] and not stem[w]:
                    hidden[w] = max((self.lexicon.get(x, 0.0) for x in terms(plain)), default=0.0)

        # hits, and how near the last one and the last word of the second person are
        hit = (own > 0) | (stem > 0) | (hidden > 0)
        place = np.arange(m)
        head = t.first[:-1][t.doc]
        near = np.zeros(t.n)
        for asked, other, strict in ((second, hit, True), (hit, second, False)):
            last = np.maximum.accumulate(np.where(other, place, -NEAR - 1)) if m else place
            if strict:  # not the word itself
                last = np.concatenate([[-NEAR - 1], last[:-1]])
            close = asked & (last >= head) & (place - last <= NEAR)
            near += t.sums(close)
        start = np.flatnonzero(hit)
        kind = beginning(kinds_, 5).dictionary_encode().indices.to_numpy().astype(np.uint64)[of[start]] if len(start) else np.zeros(0, np.uint64)
        kind = tr.sorted_kinds(t.doc[start].astype(np.uint64) << np.uint64(32) | kind) >> np.uint64(32)
        strongest = np.zeros(t.n)
        best = np.maximum(np.maximum(own, stem), hidden)
        np.maximum.at(strongest, t.doc[start], best[start])

        # letters set apart: only texts where words of lone letters follow each other are searched
        character = (t.bits & tr.WORD > 0) & (code != 95)
        solid = np.flatnonzero(character[1:] & character[:-1] & ~outer[1:-1])
        lone = np.zeros(m, bool)
        lone[t.words_at(np.flatnonzero(character))] = True
        lone[t.words_at(solid)] = False
        at, length = tr.runs(lone, t.doc)
        some = np.flatnonzero(lone[at])
        at, length = at[some], length[some]
        total = np.concatenate([[0], np.cumsum(character)])
        total = total[t.end[at + length - 1]] - total[t.start[at]] if len(at) else np.zeros(0)
        some = total >= 4
        spaced = np.zeros(t.n)
        for a, run in zip(at[some].tolist(), length[some].tolist()):
            d = t.doc[a]
            for found in _SPACED.finditer(t.full[t.start[a] : t.end[a + run - 1]].tobytes().decode("utf-32-le")):
                word = bare_of(found[0].translate(DISGUISES))
                got = max(self.lexicon.get(x, 0.0) for x in terms(word))
                spaced[d] += got > 0
                strongest[d] = max(strongest[d], got)

        big = t.bits & tr.UPPER > 0
        both = np.flatnonzero(big[1:] & big[:-1] & ~outer[1:-1]) + 1
        drawn = thrice.copy()
        drawn[1:] &= ~thrice[:-1]
        counts = t.counts()
        alpha, chars = np.maximum(tr.with_bits(counts, tr.LETTER), 1), np.maximum(np.diff(t.ends), 1)
        found = lambda flag: t.texts_at(np.flatnonzero(flag))
        ascii_marks = found((code >= 33) & (code <= 47) | (code >= 58) & (code <= 64))
        hits, stems = t.sums(own > 0), t.sums(stem > 0)
        return np.stack([
            np.log1p(t.count), hits, hits / n, np.bincount(kind.astype(np.int64), minlength=t.n), strongest, t.sums(own) / n, stems, stems / n,
            t.sums(np.where(hit, np.maximum(stem, hidden), 0)) / n, near / n, t.sums(second) / n, tr.with_bits(counts, tr.UPPER) / alpha, t.texts_at(both) / alpha,
            ascii_marks / chars, found((code == 33) | (code == 63)) / n, t.sums(odd) / n, t.sums(hidden > 0), spaced, found(drawn) / n,
            (np.diff(t.ends) - tr.with_bits(counts, tr.SPACE)) / n,
        ], 1).reshape(t.n, len(FEATURES))


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Lexicons of rows(doc_id, text, y): of each half by doc_id, and of all.

    A document counts once for a term; at most ENTRIES terms with the highest weight stay.  A term has 3 to 39
    characters, the star of a beginning included.
    """

    def found(texts: pa.Array, side: np.ndarray) -> pa.RecordBatch:
        t = tr.Letters(texts)
        bare = bare_words(t)
        of, words = bare.indices.to_numpy().astype(np.int64), bare.dictionary
        size = pa.compute.binary_length(words).to_numpy(zero_copy_only=False) // 4
        out = []
        for k in (0, *STEMS):
            fits = (size > k) & (size < 39) if k else (size > 2) & (size < 40)
            begun = (beginning(words, k) if k else words).dictionary_encode()
            term = begun.indices.to_numpy().astype(np.int64)[of[fits[of]]]
            both = tr.sorted_kinds(t.doc[fits[of]].astype(np.uint64) << np.uint64(32) | term.astype(np.uint64))
            doc, term = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            key, n = np.unique(side[doc] * (1 << 32) + term, return_counts=True)
            text = [w.decode("utf-32-le") + "*" * bool(k) for w in begun.dictionary.take(pa.array(key & 0xFFFFFFFF)).to_pylist()]
            out += zip(text, (key >> 33).tolist(), (key >> 32 & 1).tolist(), n.tolist())
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        return pa.record_batch([pa.array(c, x) for c, x in zip(zip(*out) if out else [()] * 4, types)], names=["term", "half", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(2).to_numpy()
            done = 0
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while done < len(batch):
                to = max(done + 1, int(np.searchsorted(size, (size[done - 1] if done else 0) + tr.PART, "right")))
                yield found(batch.column(1).slice(done, to - done), side[done:to])
                done = to

    halved = rows.select((F.abs(F.xxhash64(F.lit(1), "doc_id")) % 2).cast("int").alias("half"), "text", "y")
    sizes = {(r["half"], r["y"]): r["count"] for r in halved.groupBy("half", "y").count().collect()}
    sums = [F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    counted = halved.mapInArrow(run, "term string, half int, y int, n long").groupBy("term").agg(*sums)
    counted = stash(counted.where("n01 + n11 >= 3"), "terms")
    out = []
    for parts in ((0,), (1,), (0, 1)):
        total = {y: sum(sizes.get((h, y), 0) for h in parts) for y in (0, 1)}
        a, b = (sum((F.col(f"n{h}{y}") for h in parts), F.lit(0)) for y in (1, 0))
        odds = F.log((a + 0.5) / (total[1] + 1)) - F.log((b + 0.5) / (total[0] + 1))
        best = counted.where((a >= max(3, 0.004 * total[1])) & (b <= 0.5 * a)).select("term", odds.alias("odds"), (odds * F.sqrt(a)).alias("weight"))
        best = best.where("odds >= 2").orderBy(F.desc("weight"), "term").limit(ENTRIES)
        out.append({r["term"]: r["odds"] for r in best.collect()})
    return out


class Boosted:
    """Boosted trees of fixed depth on binned features: every node has a feature and a cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None):
        n, w = len(y), np.ones(len(y)) if w is None else w
        ones = float((w * y).sum())
        self.base = float(np.log((ones + 1) / (w.sum() - ones + 1)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for c in x.T]
        self.edges = [np.unique(np.concatenate([e, [0.0]])) if len(e) else np.zeros(1) for e in self.edges]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not 0 < y.sum() < n:
            return
        bins = self._bins(x)
        f = np.full(n, self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            f += self._walk(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = 2**DEPTH - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, BINS + 2, np.int64), np.zeros(inner + 1)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.zeros(count)
            for j in range(bins.shape[1]):
                width = len(self.edges[j]) + 1
                at = (node - first) * width + bins[:, j]
                cg, ch, cn = (np.bincount(at, w, count * width).reshape(count, width).cumsum(1) for w in (g, h, None))
                tg, th, tn = cg[:, -1:], ch[:, -1:], cn[:, -1:]
                gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                gain = np.where((cn >= LEAST) & (tn - cn >= LEAST), gain, 0)
                k = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(count), k] > best + 1e-9):
                    best[i], feature[first + i], cut[first + i] = gain[i, k[i]], j, k[i]
            node = 2 * node + 1 + (bins[np.arange(len(g)), feature[node]] > cut[node])
        node -= inner
        sg, sh = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf = RATE * sg / (sh + 1)
        return feature, cut, leaf

    @staticmethod
    def _walk(tree, bins: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += self._walk(tree, bins)
        return f


class Isotonic:
    """A rising step function from raw scores to shares of label 1, drawn out between the steps."""

    def __init__(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        order = np.argsort(raw, kind="stable")
        weight = np.ones(len(y)) if weight is None else weight
        blocks: list[list[float]] = []
        for r, v, w in zip(raw[order], y[order], weight[order]):
            blocks.append([v * w, w, r, r])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, w, _, top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], top]
        self.at = np.array([x for b in blocks for x in (b[2], b[3])])
        self.share = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks for _ in (0, 1)])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return 1 / (1 + np.exp(-raw))
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 / (1 + np.exp(-raw))  # the last part keeps ties apart


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.lexicon, self.trees = lexicon, Boosted(x, y, w)
        fold = np.arange(len(y)) % 2
        raw = np.zeros(len(y))
        for k in (0, 1):
            raw[fold == k] = Boosted(x[fold != k], y[fold != k], w[fold != k]).raw(x[fold == k])
        self.calibration = Isotonic(raw, y, w) if 0 < y.sum() < len(y) else None

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return self.calibration(raw) if self.calibration else 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """A model of labels.toxic, learned from the labelled documents that `learnable` admits."""
    rows = stash(tr.with_labels(docs, tr.labelled(labels, "toxic", learnable, per_class)), "labelled")
    first, second, whole = lexicons(rows)
    half = F.abs(F.xxhash64(F.lit(1), "doc_id")) % 2
    parts = [tr.matrix(tr.feature_rows(rows.where(half == h), lambda o=other: Features(o), len(FEATURES)), len(FEATURES)) for h, other in ((0, second), (1, first))]
    ids, x, y, w = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(ids, kind="stable")
    return Model(whole, x[order], y[order], w[order])


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for every row of docs.

    A null text is scored as empty, all of whose features are zero; a row without doc_id is not held out.  Repeated
    rows stay repeated; other columns are not read.  Without labels of both classes the score is their share.
    """
    return tr.scored(docs, lambda: Features(model.lexicon), model.score, len(FEATURES), 5, 0, threshold)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, that classify() predicts 0 for."""
    return tr.kept(docs, lambda: Features(model.lexicon), model.score, len(FEATURES), lambda s: s < threshold)


def op8_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels"), split_of(F.col("doc_id"), 5) != 0))
