"""Blocks of whole documents, their words, and the exchange in which blocks name what they share.

A block is one row: some megabytes of documents, packed.  A key is a word, or a
few numbers that were given to words or keys before.  Every block sends each of
its keys once to the bucket of its hash.  The bucket compares the keys
themselves, adds up what the blocks say of them and gives a number to each key
that two documents have.  So equal numbers always stand for equal words, and
hashes decide only where keys meet.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash_by

M1, M2, B1, B2 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
S33 = np.uint64(33)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


class Words:
    """The words of a block of texts: where they are, whose they are, which of the distinct words each is."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        self.texts = texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        offsets = offsets - offsets[0]
        gap = SPACE[self.bytes]
        opens = np.empty(len(gap), bool)
        if len(gap):
            opens[0] = True
            opens[1:] = gap[:-1]
            opens[offsets[:-1][offsets[:-1] < len(gap)]] = True
        self.start = np.flatnonzero(opens & ~gap)
        closes = np.empty(len(gap), bool)
        if len(gap):
            closes[-1] = True
            closes[:-1] = gap[1:]
            closes[offsets[1:][offsets[1:] > 0] - 1] = True
        self.end = np.flatnonzero(closes & ~gap) + 1
        self.first = np.searchsorted(self.start, offsets)  # the first word of each text
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.gap = gap

    def spelt(self) -> tuple[np.ndarray, pa.Array]:
        """(number of the distinct word at each place, distinct words)."""
        packed = self.bytes[~self.gap]
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary

    def windows(self, width: int) -> np.ndarray:
        """The first words of all windows: `width` consecutive words of one text."""
        if len(self.text) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[: len(self.text) - width + 1] == self.text[width - 1 :])


class _Zstd(threading.local):
    """What packs and unpacks small arrays: made once for a thread, as making it costs more than using it."""

    def __init__(self):
        self.squeeze = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False).compress
        self.expand = zstandard.ZstdDecompressor().decompress


ZSTD = _Zstd()
#: Shorter planes are kept as they are.
SHORT = 48


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array of integers, its bytes by significance: empty planes cost nothing, others what their values vary.

    ascending: only the differences of neighbours are kept.
    """
    if ascending and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    out = [len(x).to_bytes(4, "little")]
    squeeze = ZSTD.squeeze
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    for plane, some in zip(planes, planes.any(axis=1).tolist()):
        if not some:
            out.append(bytes(4))
            continue
        raw = plane.tobytes()
        small = squeeze(raw) if len(raw) >= SHORT else raw
        kept = small if len(small) < len(raw) else raw
        out += [len(kept).to_bytes(4, "little"), kept]
    return b"".join(out)


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    n, at, size = int.from_bytes(data[:4], "little"), 4, np.dtype(dtype).itemsize
    planes = np.zeros((n, size), np.uint8)
    expand = ZSTD.expand
    for k in range(size):
        length = int.from_bytes(data[at : at + 4], "little")
        kept = data[at + 4 : at + 4 + length]
        at += 4 + length
        if length:
            planes[:, k] = np.frombuffer(kept if length == n else expand(kept, max_output_size=n), np.uint8)
    x = planes.reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if ascending else x


def as_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def of_ipc(data: bytes) -> pa.RecordBatch:
    table_ = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table_.to_batches()[0] if table_.num_rows else pa.RecordBatch.from_pylist([], schema=table_.schema)


def in_blocks(docs: DataFrame, target: int) -> DataFrame:
    """block, docs, size, words: all columns of docs, about `target` bytes of text to a row; a longer document is a block
    of its own.  size and words count the bytes and words of its texts."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words = Words(whole.column(where))
            columns = [pa.array([block]), pa.array([as_ipc(whole)], pa.binary()), pa.array([len(words.bytes)]), pa.array([len(words.text)])]
            return pa.record_batch(columns, names=["block", "docs", "size", "words"])

        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(where)), 0).to_numpy(zero_copy_only=False)
            k = 0
            while k < len(sizes):
                total = np.cumsum(sizes[k:])
                n = max(1, int(np.searchsorted(total, target - size, "right")))
                held.append(batch.slice(k, n))
                size += int(total[min(n, len(total)) - 1])
                k += n
                if k < len(sizes) or size >= target:
                    yield hand_on()
                    block += 1
                    held, size = [], 0
        if held:
            yield hand_on()

    return docs.mapInArrow(run, "block long, docs binary, size long, words long")


def pack_sparse(x: np.ndarray) -> bytes:
    """Numbers that are mostly zero: how many, which are not, and those."""
    some = x > 0
    return len(x).to_bytes(8, "little") + np.packbits(some).tobytes() + pack(x[some])


def unpack_sparse(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    ends = 8 + (n + 7) // 8
    out = np.zeros(n, np.int64)
    out[np.unpackbits(np.frombuffer(data[8:ends], np.uint8), count=n).astype(bool)] = unpack(data[ends:], np.int64)
    return out


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key in their order, number of the key of each row); a key is a row of the columns."""
    n = len(columns[0])
    varied = [c for c in columns if n and (c != c[0]).any()] or columns[:1]
    bits = [int(c.max(initial=0)).bit_length() for c in varied]
    if len(varied) > 1 and sum(bits) <= 64:
        whole = varied[0]
        for c, k in zip(varied[1:], bits[1:]):
            whole = whole << np.uint64(k) | c
        varied = [whole]
    order = np.argsort(varied[0]) if len(varied) == 1 else np.lexsort(varied[::-1])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for c in varied:
        s = c[order]
        fresh[1:] |= s[1:] != s[:-1]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


def columns_of(parts: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Numbers of at most `bits` bits, as many to a column as 64 bits hold."""
    fit, out = max(1, 64 // bits), []
    for k in range(0, len(parts), fit):
        column = parts[k].astype(np.uint64)
        for p in parts[k + 1 : k + fit]:
            column = column << np.uint64(bits) | p.astype(np.uint64)
        out.append(column)
    return out


def several(of: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Which of n keys occur in two texts: `of` says which key each occurrence is of, `text` where it is."""
    at = of[distinct([of.astype(np.uint64) << np.uint64(32) | text.astype(np.uint64)])[0]]
    return np.bincount(at, minlength=n) > 1


def in_buckets(columns: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their buckets, edges of the buckets)."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * B1 + c)
    return dealt(h % np.uint64(buckets), buckets)


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))


def _spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts and the last ends, bytes) of distinct words."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return ends - ends[0], np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def word_buckets(vocabulary: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    ends, letters = _spelling(vocabulary)
    place = np.arange(1, len(letters) + 1) - np.repeat(ends[:-1], np.diff(ends))
    h = mix(letters.astype(np.uint64) + B2 * place.astype(np.uint64))
    h = mix(np.add.reduceat(h, ends[:-1], dtype=np.uint64)) if len(h) else h  # no word is empty
    return dealt(h % np.uint64(buckets), buckets)


#: What a block sends to a bucket: packed keys, and a number for each: twice its count, and one more if two documents have it.
SENT = "bucket int, block long, keys array<binary>, n binary"


def sent(block: int, keys: pa.Array | list[np.ndarray], n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows in which a block sends its keys, distinct words or rows of columns."""
    spelt = isinstance(keys, pa.Array)
    order, edges = word_buckets(keys, buckets) if spelt else in_buckets(keys, buckets)
    if spelt:
        ends, letters = _spelling(keys.take(pa.array(order)))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[k], edges[k + 1]
        at = order[a:b]
        packed = [pack(np.diff(ends[a : b + 1])), squeeze(letters[ends[a] : ends[b]].tobytes())] if spelt else [pack(c[at], j == 0) for j, c in enumerate(keys)]
        rows.append((k, block, packed, pack(n[at])))
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary()))], names=["bucket", "block", "keys", "n"])


def in_order_sent(keys: pa.Array | list[np.ndarray], buckets: int) -> np.ndarray:
    """The order in which sent() sends keys, and in which heard() hears of them."""
    return (word_buckets(keys, buckets) if isinstance(keys, pa.Array) else in_buckets(keys, buckets))[0]


def heard(told: list | None, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, count in other blocks) of each key that a block sent; keys of one document alone have number 0."""
    parts = sorted(told or (), key=lambda x: x["bucket"])
    out = []
    for c in ("id", "others"):
        x = np.zeros(len(order), np.int64)
        x[order] = np.concatenate([np.zeros(0, np.int64), *(unpack_sparse(p[c]) for p in parts)])
        out.append(x)
    return out[0], out[1]


def _met(spelt: bool, buckets: int, base: int, named: bool = True) -> Callable[[pa.Table], pa.Table]:
    """What a bucket tells the blocks of their keys."""

    def run(batch: pa.Table) -> pa.Table:
        keys, ns = batch["keys"].to_pylist(), [unpack(x, np.int64) for x in batch["n"].to_pylist()]
        if spelt:
            expand = zstandard.ZstdDecompressor().decompress
            size = np.concatenate([unpack(k[0], np.int64) for k in keys])
            letters = b"".join(expand(k[1], max_output_size=int(unpack(k[0], np.int64).sum())) for k in keys)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
            of = words.dictionary_encode().indices.to_numpy()
        else:
            _, of = distinct([np.concatenate([unpack(k[j], np.uint64, j == 0) for k in keys]) for j in range(len(keys[0]))])
        n = np.concatenate(ns)
        total = np.bincount(of, n >> 1).astype(np.int64)
        shared = (np.bincount(of) > 1) | (np.bincount(of, n & 1) > 0) if named else np.zeros(len(total), bool)
        bucket = batch["bucket"][0].as_py()
        number = np.where(shared, 1 + base + bucket + buckets * (np.cumsum(shared) - 1), 0)[of]
        others, ends = total[of] - (n >> 1), np.cumsum([len(x) for x in ns])
        parts = [slice(e - len(x), e) for x, e in zip(ns, ends)]
        columns = [batch["bucket"], batch["block"], *(pa.array([pack_sparse(x[p]) for p in parts], pa.binary()) for x in (number, others))]
        most = pa.array([int(number.max(initial=0))] * len(parts), pa.int64())
        return pa.table([*columns, most], names=["bucket", "block", "id", "others", "most"])

    return run


def told(keys: DataFrame, buckets: int, tag: str, spelt: bool = False, base: int = 0, named: bool = True) -> tuple[DataFrame, int]:
    """(block, told: what heard() takes; the greatest number given): the exchange of the keys that blocks sent.

    Numbers start beyond `base`; without `named` none are given, and only counts are told.
    """
    met = keys.groupBy("bucket").applyInArrow(_met(spelt, buckets, base, named), "bucket int, block long, id binary, others binary, most long")
    answer = met.groupBy("block").agg(F.collect_list(F.struct("bucket", "id", "others")).alias(tag), F.max("most").alias("most"))
    answer = stash_by(answer, "block", tag, dealt=True)
    most = answer.agg(F.max("most")).first()[0] or base
    return answer.select("block", tag), max(most, base)
