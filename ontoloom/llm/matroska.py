"""Media columns: payloads stored as 8-bit PCM in Matroska files, and such files parsed into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown
sizes included), clusters, simple and grouped blocks, all four kinds of lacing,
and cues.  A packet is one frame: its track, timestamp and byte range in the
file.  The writer makes one audio track, a fixed number of frames to a block and
of blocks to a cluster, and a cue for each cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples to a frame, frames to a block, blocks to a cluster, samples a second.
FRAME, FRAMES, BLOCKS, RATE = 192, 8, 32, 8000
FRAME_MS = FRAME * 1000 // RATE
#: Bytes handed on in one batch, about.
BATCH = 8 << 20


class Packet(NamedTuple):
    track: int
    timestamp_ms: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    clusters: int
    cues: list[tuple[int, int, int]]  # (time, track, cluster number)
    duration_ms: float


# Writing


def vint(n: int) -> bytes:
    """A size as EBML writes it; all ones of a length mean unknown, so they go to the next length."""
    size = 1
    while n >= (1 << 7 * size) - 1:
        size += 1
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(ident: int, content: bytes | int | str) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    elif isinstance(content, str):
        content = content.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def master(ident: int, *parts: bytes) -> bytes:
    return element(ident, b"".join(parts))


def _float(x: float) -> bytes:
    return np.array(x, ">f8").tobytes()


def block(track: int, relative_ms: int, frames: list[bytes], lacing: str = "fixed") -> bytes:
    """The content of a simple block of keyframes."""
    kind = LACINGS.index(lacing) if len(frames) > 1 else 0
    head = vint(track) + relative_ms.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
    if kind:
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == 2 and len({len(f) for f in frames}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            d, n = b - a, 1
            while not -(1 << 7 * n - 1) < d < (1 << 7 * n - 1):
                n += 1
            head += (d + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


HEADER = master(
    EBML,
    element(EBML_VERSION, 1),
    element(EBML_READ_VERSION, 1),
    element(EBML_MAX_ID, 4),
    element(EBML_MAX_SIZE, 8),
    element(DOC_TYPE, "matroska"),
    element(DOC_TYPE_VERSION, 4),
    element(DOC_TYPE_READ_VERSION, 2),
)
AUDIO_TRACK = master(
    TRACKS,
    master(
        TRACK_ENTRY,
        element(TRACK_NUMBER, 1),
        element(TRACK_UID, 1),
        element(TRACK_TYPE, 2),
        element(CODEC_ID, "A_PCM/INT/LIT"),
        element(DEFAULT_DURATION, FRAME_MS * 1_000_000),
        master(AUDIO, element(SAMPLING_FREQUENCY, _float(RATE)), element(CHANNELS, 1), element(BIT_DEPTH, 8)),
    ),
)


def write(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file whose samples are the payload, a positive multiple of FRAME bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    info = master(
        INFO,
        element(TIMESTAMP_SCALE, 1_000_000),
        element(DURATION, _float(len(payload) // FRAME * FRAME_MS)),
        element(MUXING_APP, "ontoloom"),
        element(WRITING_APP, "ontoloom"),
    )
    parts, cues, at = [info, AUDIO_TRACK], [], len(info) + len(AUDIO_TRACK)
    step = FRAME * FRAMES
    for a in range(0, len(payload), step * BLOCKS):
        time = a // FRAME * FRAME_MS
        blocks = []
        for b in range(a, min(a + step * BLOCKS, len(payload)), step):
            frames = [payload[k : k + FRAME] for k in range(b, min(b + step, len(payload)), FRAME)]
            blocks.append(element(SIMPLE_BLOCK, block(1, (b - a) // FRAME * FRAME_MS, frames, lacing)))
        cluster = master(CLUSTER, element(TIMESTAMP, time), *blocks)
        cues.append(master(CUE_POINT, element(CUE_TIME, time), master(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1), element(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return HEADER + master(SEGMENT, *parts, master(CUES, *cues))


# Reading


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """(value, place after it, whether all its bits are ones) of the variable-length integer at `at`."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer of 8 bytes or fewer at {at}")
    size = 9 - first.bit_length()
    if at + size > len(data):
        raise ValueError(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + size], "big")
    value = raw & (1 << 7 * size) - 1
    return (raw if keep_mark else value), at + size, value == (1 << 7 * size) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, start of content, end of content) of the elements from at to end, one level deep.

    An element of unknown size lasts until one that can't be its child.
    """
    while at < end:
        place = at
        ident, at, _ = read_vint(data, at, keep_mark=True)
        size, at, unknown = read_vint(data, at)
        if unknown:
            stop = at
            while stop < end:
                child, inside, _ = read_vint(data, stop, keep_mark=True)
                if child in (SEGMENT, EBML) or ident == CLUSTER and child in (CLUSTER, CUES, TRACKS, INFO):
                    break
                n, inside, endless = read_vint(data, inside)
                stop = end if endless and ident == SEGMENT else inside + n
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:x} at {place} is longer than what holds it")
        yield ident, place, at, stop
        at = stop


def read_block(data: bytes, at: int, end: int, simple: bool) -> tuple[int, int, bool, str, list[tuple[int, int]]]:
    """(track, relative time, keyframe, lacing, byte ranges of the frames) of a block."""
    track, at, _ = read_vint(data, at)
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    kind, key = flags >> 1 & 3, bool(flags & 0x80) or not simple
    if not kind:
        return track, relative, key, LACINGS[0], [(at, end - at)]
    n = data[at]
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n:
        size, at, _ = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 1):
            start = at
            d, at, _ = read_vint(data, at)
            size += d - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
    if kind == 2:
        sizes = [(end - at) // (n + 1)] * (n + 1)
    else:
        sizes.append(end - at - sum(sizes))
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    if at != end or min(sizes) < 0:
        raise ValueError("the frames of a block don't fill it")
    return track, relative, key, LACINGS[kind], ranges


def parse(data: bytes) -> Media:
    """The packets and cues of a Matroska file."""
    packets: list[Packet] = []
    places: dict[int, int] = {}
    cues, durations, scale, duration = [], {}, 1_000_000, 0.0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    for top, _, start, stop in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for ident, place, a, b in elements(data, start, stop):
            if ident == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        scale = number(x, y)
                    elif i == DURATION:
                        duration = float(np.frombuffer(data[x:y], f">f{y - x}")[0])
            elif ident == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == TRACK_ENTRY:
                        entry = {j: number(p, q) for j, _, p, q in elements(data, x, y) if j in (TRACK_NUMBER, DEFAULT_DURATION)}
                        durations[entry.get(TRACK_NUMBER, 0)] = entry.get(DEFAULT_DURATION, 0)
            elif ident == CLUSTER:
                cluster, time = len(places), 0
                places[place - start] = cluster
                for i, _, x, y in elements(data, a, b):
                    if i == TIMESTAMP:
                        time = number(x, y)
                        continue
                    inner = [(x, y)] if i == SIMPLE_BLOCK else [(p, q) for j, _, p, q in elements(data, x, y) if j == BLOCK] if i == BLOCK_GROUP else []
                    for p, q in inner:
                        track, relative, key, lacing, ranges = read_block(data, p, q, i == SIMPLE_BLOCK)
                        base, each = (time + relative) * scale, durations.get(track, 0)
                        packets += [Packet(track, (base + k * each) // 1_000_000, o, n, key, lacing, cluster) for k, (o, n) in enumerate(ranges)]
            elif ident == CUES:
                for i, _, x, y in elements(data, a, b):
                    if i == CUE_POINT:
                        when, spots = 0, []
                        for j, _, p, q in elements(data, x, y):
                            if j == CUE_TIME:
                                when = number(p, q)
                            elif j == CUE_TRACK_POSITIONS:
                                spots.append({k: number(u, v) for k, _, u, v in elements(data, p, q)})
                        cues += [(when * scale // 1_000_000, s.get(CUE_TRACK, 0), s.get(CUE_CLUSTER_POSITION, -1)) for s in spots]
    found = [(when, track, places.get(at, -1)) for when, track, at in cues]
    return Media(packets, len(places), found, duration * scale / 1e6)


def checked(data: bytes | None) -> tuple[Media | None, str | None]:
    """(what parse() gives, null) or (null, what is wrong with the file)."""
    if data is None:
        return None, "no media"
    try:
        return parse(data), None
    except (ValueError, IndexError, TypeError) as e:
        return None, f"{type(e).__name__}: {e}"


def payload_of(data: bytes, media: Media) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets])


def features_of(media: Media, payload: bytes) -> str:
    """What the packets and samples of a file say about it, in one line."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    levels = np.count_nonzero(np.bincount(samples, minlength=256))
    ends = media.packets[-1].timestamp_ms + FRAME_MS if media.packets else 0
    good = sum(c >= 0 for _, _, c in media.cues)
    lacing = ",".join(sorted({p.lacing for p in media.packets}))
    turns = int(np.count_nonzero(np.diff(samples > 100))) if len(samples) else 0
    return f"packets={len(media.packets)} clusters={media.clusters} cues={good} lacing={lacing} ms={ends} sum={samples.sum()} squares={(samples * samples).sum()} levels={levels} turns={turns}"


# Columns


def _sliced(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload): filled up with spaces to a positive multiple of FRAME bytes."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME)


def store(docs: DataFrame, lacing: str = "fixed") -> DataFrame:
    """doc_id, n_bytes, media: the text of every row of docs as a Matroska file.

    A null text counts as empty.  Repeated rows stay repeated; other columns are not read.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    n, payload = padded(text.as_py())
                    yield doc, n, write(payload, lacing)

        return _sliced(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], lambda r: len(r[2]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(stored: DataFrame) -> DataFrame:
    """The packet table of all files in the column media: one row for each frame, in order of the file.

    A null or broken file has one row, of nulls but for doc_id and error, which says what is wrong; error is null in all
    other rows.  A file without packets has none.  Repeated rows stay repeated; other columns are not read.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    media, error = checked(data.as_py())
                    if media is None:
                        yield (doc, *[None] * (1 + len(Packet._fields)), error)
                    else:
                        yield from ((doc, k, *p, None) for k, p in enumerate(media.packets))

        types = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.int64(), pa.string()]
        return _sliced(rows(), ["doc_id", "packet", *Packet._fields, "error"], types, lambda r: 80)

    return stored.select("doc_id", "media").mapInArrow(
        run, "doc_id long, packet long, track long, timestamp_ms long, offset long, size long, keyframe boolean, lacing string, cluster long, error string"
    )


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature, error: the samples that the packets of each file hold.

    For a null or broken file payload and feature are null and error says what is wrong.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for doc, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    media, error = checked(data := data.as_py())
                    payload = payload_of(data, media) if media else None
                    yield doc, n, data, payload, features_of(media, payload) if media else None, error

        names = ["doc_id", "n_bytes", "media", "payload", "feature", "error"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        return _sliced(rows(), names, types, lambda r: len(r[2] or b"") + len(r[3] or b""))

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string, error string")


def digest(back: DataFrame) -> DataFrame:
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_back(store(table(spark, sf_dir, "documents"))))
