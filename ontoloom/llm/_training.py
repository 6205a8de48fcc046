"""What the two classifiers share: labelled rows, texts as code points, features in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import split_of

#: Bytes of text looked at in one go, about; a longer text is looked at alone.
PART = 1 << 19
#: Code points told apart by kind; all beyond count as the last.
POINTS = 1 << 16

#: Features of texts: one row of the matrix for each.
Features = Callable[[pa.Array], np.ndarray]


def labelled(labels: DataFrame, column: str, learnable: Column, per_class: int) -> DataFrame:
    """doc_id, y, weight: at most `per_class` documents of each label, by the hash of doc_id.

    The weight is what a document stands for: as many as its class has for each of its sample, relative to the mean of
    all.  So the shares of the classes are those of all learnable labels, however many of them the sample holds.  Rows
    without doc_id, with labels other than 0 and 1 or with contradictory labels teach nothing.
    """
    y = labels.where(learnable & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id")
    y = y.agg(F.min(column).alias("y"), F.max(column).alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    stands = {k: n.get(k, 0) / max(1, min(n.get(k, 0), per_class)) for k in (0, 1)}
    mean = sum(n.values()) / max(1, sum(min(v, per_class) for v in n.values())) or 1.0
    of = lambda k: y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(stands[k] / mean))
    return of(0).union(of(1))


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, y, weight of the sampled documents; the sample is small by its own limit, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


#: Kinds of code points, as bits: white space, of a word, a letter, a capital, a small letter, a digit, common punctuation,
#: what ends sentences.
SPACE, WORD, LETTER, UPPER, LOWER, DIGIT, MILD, STOP = (1 << k for k in range(8))


@lru_cache(maxsize=1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """(bits, small letter) of every code point that is told apart."""
    bits = np.zeros(POINTS, np.uint8)
    small = np.arange(POINTS, dtype=np.uint32)
    for k, c in enumerate(map(chr, range(POINTS))):
        word, digit = c.isalnum() or c == "_", c.isdecimal()
        bits[k] = SPACE * c.isspace() | WORD * word | LETTER * (word and not digit and c != "_") | UPPER * c.isupper() | LOWER * c.islower() | DIGIT * digit
        low = c.lower()
        if len(low) == 1 and ord(low) < POINTS:
            small[k] = ord(low)
    bits[[ord(c) for c in ".,;:'’-"]] |= MILD
    bits[[ord(c) for c in ".!?"]] |= STOP
    return bits, small


class Letters:
    """Texts as code points, one after the other, and where their words are."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        self.n = len(texts)
        size = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        self.at, self.raw = at - at[0], memoryview(raw)[at[0] : at[-1]] if raw is not None else memoryview(b"")
        self.full = np.frombuffer(bytes(self.raw).decode().encode("utf-32-le"), np.uint32)
        self.codes = np.minimum(self.full, POINTS - 1)
        self.bits = kinds()[0][self.codes]
        gap = self.bits & SPACE > 0
        edge = np.zeros(len(gap) + 1, bool)
        edge[self.ends] = True
        opens, closes = ~gap, ~gap
        opens[1:] &= gap[:-1] | edge[1:-1]
        closes[:-1] &= gap[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.ends)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def counts(self) -> np.ndarray:
        """How many code points of each text have which bits: a row of 256 for each."""
        text = np.repeat(np.arange(self.n) << 8, np.diff(self.ends))
        return np.bincount(text | self.bits, minlength=self.n << 8).reshape(self.n, 256)

    def texts_at(self, places: np.ndarray) -> np.ndarray:
        """How many of some places, in order, are in each text."""
        return np.diff(np.searchsorted(places, self.ends))

    def words_at(self, places: np.ndarray) -> np.ndarray:
        """The words that hold some places, none of them white space."""
        return np.searchsorted(self.start, places, "right") - 1

    def word_bits(self) -> np.ndarray:
        """All bits of the code points of each word, but for those of white space."""
        return np.bitwise_or.reduceat(self.bits, self.start) if len(self.start) else self.bits[:0]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of words over each text."""
        return np.bincount(self.doc, values, self.n)

    def strings(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
        """The stretches codes[start:end], in order and apart, of the code points to keep, as binary of four bytes each."""
        inside = np.zeros(len(codes) + 1, np.int64)
        inside[start] += 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        if keep is not None:
            inside &= keep
        total = np.concatenate([[0], np.cumsum(inside)])
        ends = np.append(total[start], total[-1]) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes[inside].astype("<u4"))])


def with_bits(counts: np.ndarray, bits: int, without: int = 0) -> np.ndarray:
    """Of Letters.counts(), the code points of each text that have some of the bits, and none of others."""
    every = np.arange(256)
    return counts[:, (every & bits > 0) & (every & without == 0)].sum(axis=1)


def sorted_kinds(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def runs(values: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal runs of one value in one part."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (parts[1:] != parts[:-1])
    at = np.flatnonzero(fresh)
    return at, np.diff(np.append(at, len(values)))


def in_parts(features: Features, texts: pa.Array, width: int) -> np.ndarray:
    """The features of any number of texts, some megabytes at a time."""
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, k = [np.zeros((0, width))], 0
    total = np.cumsum(size)
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PART, "right")))
        out.append(features(texts.slice(k, to - k)))
        k = to
    return np.concatenate(out)


def feature_rows(rows: DataFrame, of_texts: Callable[[], Features], width: int) -> DataFrame:
    """rows without text, then x: the features of each text; a null text counts as empty."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = of_texts()
        for batch in batches:
            x = pa.array(list(in_parts(features, batch.column(at), width)), pa.list_(pa.float64()))
            yield pa.record_batch([*(batch.column(f.name) for f in keep), x], names=[*(f.name for f in keep), "x"])

    return rows.mapInArrow(run, T.StructType([*keep, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def matrix(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, x, y, weight) of a bounded labelled sample, in order of doc_id, on the driver."""
    got = rows.select("doc_id", "y", "weight", "x").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, width)
    ids, y, w = (got[c].to_numpy() for c in ("doc_id", "y", "weight"))
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order].astype(np.int64), x[order], y[order].astype(float), w[order].astype(float)


def scored(docs: DataFrame, of_texts, score: Callable[[np.ndarray], np.ndarray], width: int, modulus: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = of_texts()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score(in_parts(features, batch.column(1), width)), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(split_of(F.col("doc_id"), modulus) == held, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, of_texts, score: Callable[[np.ndarray], np.ndarray], width: int, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, whose scores `keep` accepts."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = of_texts()
        for batch in batches:
            yield batch.filter(pa.array(keep(score(in_parts(features, batch.column(at), width))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
