"""Best-fit packing of token pieces into sequences under several capacities.

A piece takes tokens, one place among the documents of its sequence, and
attention cost (the square of its length).  Pieces of one length are alike, so
vector best-fit decreasing runs over the histogram of lengths, at most as many
entries as a sequence has tokens: bins with equal contents form a class, and a
step fills a whole class.  Every piece then finds its place from its length and
its rank among the pieces of that length, without a shuffle of the pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from ._shared import free_name, stash, table

#: Pieces handed on in one batch.
BATCH = 1 << 16
#: Documents to a sequence, at most, unless the caller says otherwise: it binds where many short ones would meet, so that
#: attention masks stay small.  On the lengths of sf0.1 it takes 9,873 sequences instead of 9,872; no packing has under 9,871.
DOCUMENTS = 32


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text to ids, as tokenizers encodes with the vocabulary file, special strings included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = bpe.byte_of_char()
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in special.values()}
    fast = tiktoken.Encoding("bytes", pat_str=bpe.PRE_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern engine gives up on very long runs of white space
            return np.frombuffer(bpe.codec(path).encode(text), "<u4")

    return encode


def pieces(docs: DataFrame, path: str, tokens: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, chunk, local: the pieces of every row of docs.

    A document is its ids, then `end`.  Only one of more than `tokens` ids is cut; all pieces but the first then have
    that length.  local counts pieces of one length in a chunk, which is the work of one task.  A null text counts as
    empty; repeated rows stay repeated; other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "local"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, seen, held = _encoder(path), TaskContext.get().partitionId(), Counter(), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                cuts = [0, *range(len(ids) % tokens or tokens, len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    held.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), chunk, seen[b - a]))
                    seen[b - a] += 1
            while len(held) >= BATCH:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held[:BATCH]), types)], names=names)
                held = held[BATCH:]
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, local long"
    )


@dataclass
class BinClass:
    """Bins with the same contents: (length, how many of it to a bin), in the order of their places."""

    bins: int
    room: np.ndarray
    contents: list[tuple[int, int]] = field(default_factory=list)


def fit(histogram: dict[int, int], capacity: tuple[int, int, int], weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> list[BinClass]:
    """Vector best-fit decreasing.

    rule "norm" takes the bin whose residual capacities, weighted and relative to the capacities, have the least norm
    once the piece is in; "dot" the one whose residual capacities have the greatest weighted dot product with what
    the piece takes.  A bin is opened only if no open one has room under every capacity.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    classes: list[BinClass] = []
    rooms = np.zeros((0, 3))

    def put(at: int, bins: int, each: int, length: int, item: np.ndarray) -> None:
        """Give `each` pieces to `bins` bins of a class; the others stay as they were."""
        nonlocal rooms
        old = classes[at]
        new = BinClass(bins, old.room - each * item, [*old.contents, (length, each)])
        if bins == old.bins:
            classes[at], rooms[at] = new, new.room
        else:
            old.bins -= bins
            classes.append(new)
            rooms = np.vstack([rooms, new.room])

    for length in sorted(histogram, reverse=True):
        left, item = histogram[length], np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            open_ = np.flatnonzero((rooms >= item).all(axis=1))
            if not len(open_):
                each = min(left, int((cap // item).min()))
                classes.append(BinClass(max(1, left // each), cap))
                rooms = np.vstack([rooms, cap])
                at = len(classes) - 1
            elif rule == "norm":
                at = int(open_[np.argmin(((((rooms[open_] - item) / cap) ** 2) * w).sum(axis=1))])
                each = int((rooms[at] // item).min())
            else:
                at = int(open_[np.argmax((rooms[open_] / cap * (item / cap) * w).sum(axis=1))])
                each = 1
            each = min(each, left)
            bins = min(classes[at].bins, left // each)
            put(at, bins, each, length, item)
            left -= bins * each
    return classes


class Places:
    """Where the pieces of each length go, by rank."""

    def __init__(self, classes: list[BinClass]):
        rows, taken, base = [], Counter(), 0
        for c in classes:
            offset = 0
            for length, each in c.contents:
                rows.append((length, taken[length], base, each, offset))
                taken[length] += c.bins * each
                offset += length * each
            base += c.bins
        table_ = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.start, self.base, self.each, self.offset = table_.T
        self.key = self.length << 44 | self.start

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        k = rank - self.start[at]
        return self.base[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def pack(cut: DataFrame, tokens: int = 1024, documents: int | None = None, cost: int | None = None, rule: str = "norm") -> DataFrame:
    """cut without chunk and local, then sequence_id and offset: a place for every piece, gapless from 0.

    tokens, documents, cost: the capacities of a sequence; without documents or cost, that one never binds.  cost bounds
    the sum of the squares of lengths; as a whole piece of `tokens` costs tokens ** 2, it binds only over shorter pieces.
    An empty table stays empty.
    """
    place, so_far = (free_name(c, cut.columns) for c in ("rank", "before"))
    counts = stash(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(fit(histogram, (tokens, documents or tokens, cost or tokens * tokens), rule=rule))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(so_far))
    names = [c for c in cut.columns if c not in ("chunk", "local")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", place))
            sequence, offset = places.of(length, rank)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = cut.join(counts, ["chunk", "length"]).select(*names, (F.col(so_far) + F.col("local")).alias(place))
    return ranked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*names).schema) + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str, tokens: int = 1024, documents: int | None = DOCUMENTS, cost: int | None = None, rule: str = "norm"
) -> DataFrame:
    """pieces() of docs, packed by pack(): see there for the columns, and for nulls, empty texts and repeated rows."""
    return pack(stash(pieces(docs, path, tokens), "pieces"), tokens, documents, cost, rule)


def op6_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # as few sequences as can be: tokens are the only limit
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), documents=None)
