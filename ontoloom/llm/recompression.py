"""Repeated passages, found by recompression.

Spark rounds name what blocks of documents share.  The first names words as they
are spelt; the second, maximal runs of one word and pairs of them; each later
one, pairs of the symbols so far.  A round parts all symbols into lefts and
rights by one bit of a hash of their numbers and pairs every left with a right
that follows it.  Equal keys get equal numbers wherever they stand (see
_blocks), and a symbol that one document alone has gets none: it pairs with
nothing any more, and no window that holds it repeats.  By induction equal
numbers stand for equal words, however hashes fall.

What a symbol is called depends only on the words in its extent: its own and the
few beside it that decided its pairing.  So equal passages carry equal symbols
inside.  After every round a block keeps only the stretches of words whose
windows may still repeat; what stands beside a stretch is beyond any window in
it, so a decision that would need it counts as made outside.  In the end each
window of `width` words elects the highest symbol that it holds as its anchor.
The words around an anchor go to its bucket as numbers, and there windows are
compared word by word; the bucket tells each block which of them an earlier
document of another block has.  The block adds the windows repeated within
itself and drops their words.

A block is one row: some megabytes of whole documents, packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ._blocks import B1, B2, SENT, Words, dealt, distinct, heard, in_blocks, in_order_sent, mix, of_ipc, pack, sent, several, told, unpack
from ._shared import free_name, stash_by, table, unstash

#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK = 4 << 20
#: Keys that meet in a bucket, about.  Every block sends to every bucket, so messages grow with the square of the input
#: over the sizes of both.
BUCKET = 1 << 21
#: Rounds that name pairs.  A symbol's extent, some four or five words wide after three of them, has to fit into a window.
ROUNDS = 3


#: What a row of a state holds for the next exchange, but the block: keys, or the passages around anchors.
KEYS = pa.struct([("bucket", pa.int32()), ("keys", pa.list_(pa.binary())), ("n", pa.binary())])
PASSAGES = pa.struct([("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "windows", "first"))])


class Level:
    """The symbols of a round, in order: number (0: one document alone has it), the words [start, stop) that each stands
    for, its extent [low, high) and its run length.

    Where the end of a stretch had a part in it, low or high lies outside, so that no window holds the symbol.
    """

    def __init__(self, number: np.ndarray, start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray, run: np.ndarray | None = None):
        self.number, self.start, self.stop, self.low, self.high = number, start, stop, low, high
        self.run = np.ones(len(number), np.int64) if run is None else run

    def runs(self, stretch: np.ndarray) -> Level:
        """Maximal runs of one word; each saw the words beside it.  A word without number decides nothing."""
        fresh = np.ones(len(self.number), bool)
        fresh[1:] = (self.number[1:] != self.number[:-1]) | (stretch[1:] != stretch[:-1]) | (self.number[1:] == 0)
        at = np.flatnonzero(fresh)
        to = np.append(at, len(fresh))[1:]
        seen = self.number[at] > 0
        return Level(self.number[at], at, to, at - seen, to + seen, to - at)

    def pairs(self, turn: int, stretch: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], Level]:
        """(symbols of the next round that need a number, their keys, that round with the numbers of the others).

        stretch: of each word; edges: where each stretch starts, and where the last ends.
        """
        number, run = self.number.astype(np.uint64), self.run.astype(np.uint64)
        live = self.number > 0
        right = mix(number * B1 + run * B2 + np.uint64(turn)) >> np.uint64(63) == 1
        left, right = live & ~right, live & right
        own = stretch[self.start]
        beside = (self.stop[:-1] == self.start[1:]) & (own[:-1] == own[1:])
        meet = left[:-1] & right[1:] & beside
        low, high = edges[own] - 1, edges[own + 1] + 1  # what a right saw before it, and a left after it
        low[1:] = np.where(beside, np.minimum(self.low[1:], self.low[:-1]), low[1:])
        high[:-1] = np.where(beside, np.maximum(self.high[:-1], self.high[1:]), high[:-1])
        low, high = np.where(right, low, self.low), np.where(left, high, self.high)
        follower, spans, stop = np.zeros(len(number), np.uint64), run << np.uint64(32), self.stop.copy()
        follower[:-1][meet] = number[1:][meet]
        spans[:-1][meet] |= run[1:][meet]
        stop[:-1][meet] = self.stop[1:][meet]
        keep = ~np.insert(meet, 0, False)[: len(number)]
        new = np.flatnonzero((live & ((follower > 0) | (self.run > 1)))[keep])
        keys = [c[keep][new] for c in (number, follower, spans)]
        return new, keys, Level(self.number[keep], self.start[keep], stop[keep], low[keep], high[keep])

    def within(self, kept: np.ndarray, edges: np.ndarray, of: np.ndarray, before: np.ndarray, after: np.ndarray) -> Level:
        """The symbols whose words are all kept.  kept counts kept words before each; of, before and after give the new
        stretch of each old word and where new stretches started and ended; edges are the new ones."""
        some = kept[self.stop] - kept[self.start] == self.stop - self.start
        start, stop, low, high = (x[some] for x in (self.start, self.stop, self.low, self.high))
        s = of[start]
        at, to = kept[start], kept[stop]
        low = np.where(low >= before[s], at - (start - low), edges[s] - 1)
        high = np.where(high <= after[s], to + (high - stop), edges[s + 1] + 1)
        return Level(self.number[some], at, to, low, high, self.run[some])


class Spelt:
    """The words of a block, for the round that names words."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        words, self.width = Words(batch.column("text")), width
        judged = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (words.count >= width)
        self.at = np.flatnonzero(judged[words.text])  # the words that windows cover
        self.text = words.text[self.at]
        self.owner = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, vocabulary = words.spelt()
        used, self.of = np.unique(ids[self.at], return_inverse=True)
        self.vocabulary = vocabulary.take(pa.array(used))

    def send(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        yield from sent(block, self.vocabulary, several(self.of, self.text, len(self.vocabulary)).astype(np.int64), buckets)

    def learn(self, told_: list | None, buckets: int) -> Symbols:
        number = heard(told_, in_order_sent(self.vocabulary, buckets))[0][self.of]
        edges = np.append(np.flatnonzero(np.diff(self.text, prepend=-1)), len(self.text))
        out = Symbols(self.width, number, edges, self.at[edges[:-1]], self.owner[self.text[edges[:-1]]], [])
        return out.pruned()


class Symbols:
    """The symbols of a block, round by round, in the stretches of words whose windows may repeat.

    number: of each word; edges: where each stretch starts, and where the last ends; at, owner: the first word of each
    stretch in the block, and its document.  levels: the words, and the symbols of the last of `turn` rounds; what
    earlier rounds ruled out is gone with the stretches, or is ruled out when windows are compared.
    """

    def __init__(self, width: int, number: np.ndarray, edges: np.ndarray, at: np.ndarray, owner: np.ndarray, levels: list[Level], turn: int = 0):
        self.width, self.edges, self.at, self.owner, self.turn = width, edges, at, owner, turn
        self.stretch = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        n = np.arange(len(number))
        self.levels = levels or [Level(number, n, n + 1, n, n + 1)]

    def dump(self) -> bytes:
        """As bytes: of the words their numbers alone."""
        arrays = [np.array([self.turn]), self.levels[0].number, np.diff(self.edges), np.diff(self.at, prepend=0), self.owner]
        for x in self.levels[1:]:
            arrays += [x.number, np.diff(x.start, prepend=0), x.stop - x.start, x.start - x.low, x.high - x.stop]
        packed = [pack(a.astype(np.int64)) for a in arrays]
        return b"".join(len(x).to_bytes(4, "little") + x for x in packed)

    @classmethod
    def load(cls, data: bytes, width: int) -> Symbols:
        arrays, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            arrays.append(unpack(data[at + 4 : at + 4 + n], np.int64))
            at += 4 + n
        turn, number, size, gap, owner = arrays[:5]
        out = cls(width, number, np.concatenate([[0], np.cumsum(size)]), np.cumsum(gap), owner, [], int(turn[0]))
        if len(arrays) > 5:
            number, gap, size, before, after = arrays[5:]
            start = np.cumsum(gap)
            out.levels.append(Level(number, start, start + size, start - before, start + size + after))
        return out

    def _keys(self):
        """(symbols to name, what to send for them, which of that each is, their round) of the round that comes next."""
        last = self.levels[-1] if self.turn else self.levels[0].runs(self.stretch)
        new, keys, level = last.pairs(self.turn, self.stretch, self.edges)
        first, of = distinct(keys)
        return new, [k[first] for k in keys], of, level

    def send(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        new, keys, of, level = self._keys()
        yield from sent(block, keys, several(of, self.owner_text()[self.stretch[level.start[new]]], len(keys[0])).astype(np.int64), buckets)

    def owner_text(self) -> np.ndarray:
        """A number for the document of each stretch."""
        return np.unique(self.owner, return_inverse=True)[1]

    def learn(self, told_: list | None, buckets: int) -> Symbols:
        new, keys, of, level = self._keys()
        level.number[new] = heard(told_, in_order_sent(keys, buckets))[0][of]
        self.levels, self.turn = [self.levels[0], level], self.turn + 1
        return self.pruned()

    def _dead(self, levels: list[Level]) -> np.ndarray:
        """Whether each window is across stretches or holds the extent of a symbol without number."""
        n, width = len(self.stretch), self.width
        held = np.zeros(n + 2, np.int64)
        for x in levels:
            alone = (x.number == 0) & (x.low >= 0) & (x.high <= n) & (x.high - x.low <= width)
            held += np.bincount(np.maximum(x.high[alone] - width, 0), minlength=n + 2) - np.bincount(x.low[alone] + 1, minlength=n + 2)
        m = max(0, n - width + 1)
        return (np.cumsum(held)[:m] > 0) | (self.stretch[:m] != self.stretch[width - 1 :])

    def pruned(self) -> Symbols:
        """Without the words that no window covers whose symbols all have numbers."""
        n, live = len(self.stretch), np.flatnonzero(~self._dead(self.levels[-1:]))
        keep = np.cumsum((np.bincount(live, minlength=n + 1) - np.bincount(live + self.width, minlength=n + 1))[:n]) > 0
        fresh = keep.copy()
        fresh[1:] &= ~keep[:-1] | (self.stretch[1:] != self.stretch[:-1])
        of, kept = np.cumsum(fresh) - 1, np.concatenate([[0], np.cumsum(keep)])
        before = np.flatnonzero(fresh)
        size = np.bincount(of[keep], minlength=len(before))
        edges, old = np.concatenate([[0], np.cumsum(size)]), self.stretch[before]
        levels = [x.within(kept, edges, of, before, before + size) for x in self.levels]
        return Symbols(self.width, levels[0].number, edges, self.at[old] + before - self.edges[old], self.owner[old], levels, self.turn)

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows all of whose symbols are shared, the number of each one's anchor, where that stands)."""
        at = np.flatnonzero(~self._dead(self.levels))
        symbol, place, before = np.zeros(len(at), np.uint64), np.full(len(at), -1), 0
        for level in reversed(self.levels):
            free = np.flatnonzero(place < 0)
            i, j = np.searchsorted(level.low, at[free]), np.searchsorted(level.high, at[free] + self.width, "right")
            rank = mix(level.number.astype(np.uint64) ^ B2)
            best, least = np.full(len(free), -1), np.full(len(free), np.iinfo(np.uint64).max)
            for k in range(int((j - i).max(initial=0))):
                some = np.flatnonzero(i + k < j)
                r = rank[i[some] + k]
                better = (best[some] < 0) | (r < least[some])
                some = some[better]
                best[some], least[some] = i[some] + k, r[better]
            got = best >= 0
            symbol[free[got]], place[free[got]] = level.number[best[got]].astype(np.uint64), before + best[got]
            before += len(level.number)
        return at, symbol, place


class Passages:
    """What a block asks of the buckets: stretches of words whose windows have one anchor, each distinct one once."""

    def __init__(self, block: Symbols):
        self.at, symbol, place = block.anchored()
        n, width = len(self.at), block.width
        fresh = np.ones(n, bool)
        fresh[1:] = (self.at[1:] != self.at[:-1] + 1) | (place[1:] != place[:-1])
        start = np.flatnonzero(fresh)
        windows = np.diff(np.append(start, n))
        length = windows + width - 1
        flat = np.repeat(self.at[start] - np.cumsum(length) + length, length) + np.arange(length.sum())
        spelt = block.levels[0].number[flat].astype("<u8") if len(flat) else np.zeros(0, "<u8")
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        known = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends * 8), pa.py_buffer(spelt)]).dictionary_encode()
        of = known.indices.to_numpy().astype(np.int64)
        self.n = len(known.dictionary)
        head = np.zeros(self.n, np.int64)
        head[of[::-1]] = np.arange(len(of))[::-1]  # the first place of each distinct passage
        self.first = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(self.first, of, block.owner[block.stretch[self.at[start]]])
        self.windows, self.symbol = windows[head], symbol[start[head]]
        self.spelt, self.ends, self.head = spelt, ends, head
        # for each window: its passage, and its number among the windows of all distinct passages
        self.of = np.repeat(of, windows)
        base = np.cumsum(self.windows) - self.windows
        self.number = np.repeat(base[of] - start, windows) + np.arange(n)
        own = block.stretch[self.at]
        self.owner, self.place = block.owner[own], block.at[own] + self.at - block.edges[own]

    def _dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return dealt(mix(self.symbol) % np.uint64(buckets), buckets)

    def send(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        order, edges = self._dealt(buckets)
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            words = np.concatenate([self.spelt[self.ends[h] : self.ends[h + 1]] for h in self.head[own].tolist()])
            rows.append((k, block, pack(words), pack(self.windows[own]), pack(self.first[own])))
        if rows:
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "block", "words", "windows", "first"])

    def repeated(self, told_: list | None, buckets: int) -> np.ndarray:
        """The first words, in the block, of the windows whose words an earlier document has."""
        order, edges = self._dealt(buckets)
        elsewhere = np.zeros(int(self.windows.sum()), bool)
        base = np.cumsum(self.windows) - self.windows
        bits = [np.unpackbits(np.frombuffer(x["earlier"], np.uint8)) for x in sorted(told_ or (), key=lambda x: x["bucket"])]
        for k, got in zip(np.flatnonzero(np.diff(edges)).tolist(), bits, strict=True):
            own = order[edges[k] : edges[k + 1]]
            n = self.windows[own]
            elsewhere[np.repeat(base[own] - np.cumsum(n) + n, n) + np.arange(n.sum())] = got[: n.sum()]
        return self.place[elsewhere[self.number] | (self.owner > self.first[self.of])]


def same_windows(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The number of the distinct window at each of `at`: a hash puts them in order, the words themselves are compared."""
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = mix(h * B1 + words[at + j])
    order = np.argsort(h, kind="stable")
    fresh = np.ones(len(at), bool)
    fresh[1:] = h[order][1:] != h[order][:-1]
    unlike = np.zeros(len(at), bool)
    for j in range(width):
        w = words[at + j][order]
        unlike[1:] |= w[1:] != w[:-1]
    if (unlike & ~fresh).any():  # one hash for two windows
        return distinct([words[at + j] for j in range(width)])[1]
    of = np.empty(len(at), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return of


def _earlier(width: int):
    """For a bucket: which windows of a block an earlier document of another block has."""

    def run(batch: pa.Table) -> pa.Table:
        words = [unpack(x, np.uint64) for x in batch["words"].to_pylist()]
        windows = [unpack(x, np.int64) for x in batch["windows"].to_pylist()]
        first = np.concatenate([unpack(x, np.int64) for x in batch["first"].to_pylist()])
        n = np.concatenate(windows)
        length = n + width - 1
        at = np.repeat(np.cumsum(length) - length - np.cumsum(n) + n, n) + np.arange(n.sum())
        of = same_windows(np.concatenate(words), at, width)
        owner = np.repeat(first, n)
        least = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, owner)
        told_ = least[of] < owner
        ends = np.cumsum([x.sum() for x in windows])
        bits = [np.packbits(told_[e - x.sum() : e]).tobytes() for x, e in zip(windows, ends)]
        return pa.table([batch["bucket"], batch["block"], pa.array(bits, pa.binary())], names=["bucket", "block", "earlier"])

    return run


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """All columns of docs, text without its repeated words, then n_words and n_removed.

    A word goes if a window of `width` consecutive words covers it whose words also start in a document with a
    smaller doc_id; kept words are joined by one space.  A null text has no words and becomes empty.  A row without
    doc_id is kept whole and makes no other row lose words.  Rows that repeat a doc_id are judged alike and do not
    judge each other.  Where docs has a column n_words or n_removed it stays, and the new one gets underscores after
    its name.
    """
    where = docs.columns.index("text")
    counts = [free_name(c, docs.columns) for c in ("n_words", "n_removed")]
    blocks = stash_by(in_blocks(docs, BLOCK), "block", "blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks, buckets = blocks.select("block", "docs"), max(8, size // 8 // BUCKET)

    def over(rows: DataFrame, schema: str | T.StructType, f) -> DataFrame:
        """What f(block, packed, told) gives for every row of rows(block, packed, told or nothing)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(1), *(c for c in batch.columns[2:])):
                    yield from f(row[0], row[1].as_py(), *(x.as_py() for x in row[2:]))

        return rows.mapInArrow(run, schema)

    def state(block: int, symbols: Symbols, out: Iterator[pa.RecordBatch], fields: pa.StructType) -> Iterator[pa.RecordBatch]:
        """The symbols of a block, and what it sends in the next exchange, as one row."""
        sends = [pa.StructArray.from_arrays([x.column(f.name) for f in fields], fields=list(fields)) for x in out]
        if len(symbols.stretch):
            rows = pa.concat_arrays([pa.array([], fields), *sends])
            row = [pa.array([block]), pa.array([symbols.dump()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)]
            yield pa.record_batch(row, names=["block", "state", "out"])

    def drop(block: int, data: bytes, gone: bytes | None) -> Iterator[pa.RecordBatch]:
        batch, gone = of_ipc(data), unpack(gone, np.int64) if gone else np.zeros(0, np.int64)
        words = Words(batch.column("text"))
        n = len(words.text)
        removed = np.cumsum(np.bincount(gone, minlength=n + 1) - np.bincount(gone + width, minlength=n + 1))[:n] > 0
        n_removed = np.bincount(words.text[removed], minlength=len(batch))
        columns = list(batch.columns)
        columns[where] = pa.array([_kept(words, k, removed if m else None) for k, m in enumerate(n_removed.tolist())], pa.string())
        yield pa.record_batch([*columns, pa.array(words.count), pa.array(n_removed)], names=[*batch.schema.names, *counts])

    def learnt(turn: int):
        """A round: what the buckets told the block, and its symbols and keys after that; after the last, its passages."""

        def run(block: int, data: bytes, told_: list | None) -> Iterator[pa.RecordBatch]:
            before = Spelt(of_ipc(data), width) if not turn else Symbols.load(data, width)
            symbols = before.learn(told_, buckets)
            if turn == ROUNDS:
                yield from state(block, symbols, Passages(symbols).send(block, buckets), PASSAGES)
            else:
                yield from state(block, symbols, symbols.send(block, buckets), KEYS)

        return run

    keys = over(blocks, SENT, lambda block, data: Spelt(of_ipc(data), width).send(block, buckets))
    at, most, last = blocks.withColumnRenamed("docs", "state"), 0, None
    for turn in range(ROUNDS + 1):
        answer, most = told(keys, buckets, f"round{turn}", spelt=not turn, base=most)
        fields = from_arrow_type(pa.list_(PASSAGES if turn == ROUNDS else KEYS))
        schema = T.StructType().add("block", "long").add("state", "binary").add("out", fields)
        rows = over(at.join(answer, "block", "left").select("block", "state", f"round{turn}"), schema, learnt(turn))
        rows = stash_by(rows, "block", "state", dealt=True)
        if last:
            unstash(last)
        at, last = rows.select("block", "state"), rows
        keys = rows.select("block", F.explode("out").alias("out")).select("block", "out.*")
    met = keys.groupBy("bucket").applyInArrow(_earlier(width), "bucket int, block long, earlier binary")
    answer = met.groupBy("block").agg(F.collect_list(F.struct("bucket", "earlier")).alias("earlier"))
    heard_ = at.join(answer, "block").select("block", "state", "earlier")
    as_row = lambda k, x: iter([pa.record_batch([pa.array([k]), pa.array([pack(x)], pa.binary())], names=["block", "gone"])])
    gone = over(heard_, "block long, gone binary", lambda k, data, t: as_row(k, Passages(Symbols.load(data, width)).repeated(t, buckets)))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return over(blocks.join(gone, "block", "left").select("block", "docs", "gone"), schema, drop)


def _kept(words: Words, k: int, removed: np.ndarray | None) -> str:
    """The kept words of a text, all of them without `removed`."""
    own = words.texts[k].as_py().encode().split()
    if removed is not None:
        own = [w for w, gone in zip(own, removed[words.first[k] : words.first[k + 1]].tolist()) if not gone]
    return b" ".join(own).decode()


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
s as (select doc_id, words, unnest(generate_series(1, len(words) - 12)) i from d where len(words) >= 13),
w as (select doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') passage from s),
m as (select passage, min(doc_id) first from w group by passage),
hit as (select distinct doc_id, i + unnest(range(13)) p from w join m using (passage) where first < doc_id),
gone as (select doc_id, list(p) spots from hit group by doc_id)
select doc_id, cast(len(words) as bigint) n_words, cast(coalesce(len(spots), 0) as bigint) n_removed,
  sha256(case when spots is null then array_to_string(words, ' ') else array_to_string(list_filter(words, lambda x, k: not list_contains(spots, k)), ' ') end) kept_sha256
from d left join gone using (doc_id)
"""
