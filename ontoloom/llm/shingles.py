"""Near-duplicates by the Jaccard similarity of word shingles.

Equal sets of shingles count once.  Each gets a SimHash, and the vantage-point
tree of simhash finds which of these lie within a radius: what they join is a
bucket of candidates.  Their sets are compared, and those whose true similarity
is high enough are linked.  At a similarity of 0.8 many SimHashes differ in more
bits than a tree can search for, so MinHash signatures, cut into bands, give the
rest: sets that share a band meet in its bucket too, where sketches, a byte of
each of some hashes, sort out the many that share a passage and no more.  A
bucket is searched breadth first, so a
large group of near copies costs about one comparison a member and gives a
spanning tree instead of all pairs; the trees are joined by components().  The
SimHashes go first; of the bands only buckets whose
members are not yet in one component are searched.  A
bucket of more than some megabytes is searched in parts first; then those of its
members that are not in its greatest component by now meet all others, again
part by part.  So no pair of a bucket is left out and no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import stash
from .simhash import fingerprint_of, keep_least
from .simhash import links as within

#: Words to a shingle, and the similarity of near copies.
WIDTH, SIMILAR = 5, 0.8
#: Bands and hashes to a band: a pair of similarity 0.8 shares none with a probability of (1 - 0.8 ** 5) ** 20 = 0.0004.
BANDS, HASHES = 20, 5
#: Hashes of which a sketch has a byte, and bytes that have to agree: of sets of similarity 0.8 one pair in 100 million has
#: fewer.  Buckets of more members go on without a look at their sketches.
SKETCH, AGREE, SKETCHED = 60, 30, 2000
#: Bits in which the SimHashes of candidates may differ.
RADIUS = 8
#: Shingles hashed at once; shingles to a part of a bucket, about.
BLOCK, PART = 1 << 13, 1 << 21

_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * HASHES, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(first, last)], np.uint64))


def _key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def signature(found: np.ndarray) -> np.ndarray:
    """The least of every hash over a set; the greatest number without shingles."""
    least = np.full(BANDS * HASHES, np.iinfo(np.uint64).max)
    for k in range(0, len(found), BLOCK):
        h = found[k : k + BLOCK] * _FACTORS[:, None] + _OFFSETS[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, h.min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A hash for each band of a signature."""
    rows = np.ascontiguousarray(least.reshape(BANDS, HASHES))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def sketch(least: np.ndarray) -> bytes:
    """A byte of each of the first hashes of a signature."""
    return ((least[:SKETCH] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def promising(bucket: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Which rows, in order of their buckets, have another one of their bucket whose sketch agrees enough."""
    out = np.zeros(len(bucket), bool)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(bucket))  # rows from here to the end of the bucket
    for apart in range(1, int(left.max(initial=0))):
        i = np.flatnonzero(left > apart)
        i = i[(sketches[i] == sketches[i + apart]).sum(axis=1) >= AGREE]
        out[i] = out[i + apart] = True
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (n, key, size, turn, band, sketch), sorted by band, of bands of many members or with a promising other."""
    held: pa.Table | None = None

    def judged(rows: pa.Table) -> pa.RecordBatch:
        band = rows["band"].to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        keep, small = np.ones(len(band), bool), rows["n"].to_numpy() <= SKETCHED
        keep[small] = promising(band[small], sketches[small])
        return rows.filter(pa.array(keep)).select(["key", "size", "turn", "band"]).combine_chunks().to_batches(max_chunksize=1 << 30)

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        band = rows["band"].to_numpy()
        cut = int(np.searchsorted(band, band[-1], "left")) if len(band) else 0
        if rows["n"][-1].as_py() > SKETCHED and cut < len(band):  # a large bucket needs not be held
            cut = len(band)
        held = rows.slice(cut)
        yield from judged(rows.slice(0, cut))
    if held is not None:
        yield from judged(held)


def similar_links(sets: list[np.ndarray], similar: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """(a, b): links of similar sets that connect exactly what all links of such sets do."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    members = [flat[e - n : e] for e, n in zip(ends, sizes)]
    mark = np.zeros(flat.max() + 1, np.int64)
    left = np.arange(len(sets))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            a = todo.pop()
            fits = np.flatnonzero((sizes[left] >= similar * sizes[a] - 1e-9) & (sizes[a] >= similar * sizes[left] - 1e-9))
            if not len(fits):
                continue
            mark[members[a]] = 1
            starts = np.cumsum([0, *sizes[left[fits]][:-1]])
            common = np.add.reduceat(mark[np.concatenate([members[b] for b in left[fits]])], starts)
            mark[members[a]] = 0
            hit = fits[common >= similar * (sizes[a] + sizes[left[fits]] - common) - 1e-9]
            yield from ((int(a), int(b)) for b in left[hit])
            todo += left[hit].tolist()
            left = np.delete(left, hit)


def crossing_links(some: list[np.ndarray], sets: list[np.ndarray], similar: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """(i, j): every pair of similar sets, the first of `some`, the second of `sets`."""
    sizes = np.array([len(s) for s in sets])
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    for i, own in enumerate(some):
        fits = np.flatnonzero((sizes >= similar * len(own) - 1e-9) & (len(own) >= similar * sizes - 1e-9))
        if not len(fits):
            continue
        mark = np.isin(kinds, own, assume_unique=True)
        starts = np.cumsum([0, *sizes[fits][:-1]])
        common = np.add.reduceat(mark[np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in fits])].astype(np.int64), starts)
        yield from ((i, int(j)) for j in fits[common >= similar * (len(own) + sizes[fits] - common) - 1e-9])


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """doc_id, component_id: one row for every row of docs.

    component_id is the smallest doc_id that links of similarity `similar` or more reach.  Texts without words, null
    ones among them, are alike; a text of fewer words than a shingle is one shingle.  A row without doc_id belongs to
    its component, whose id is null if no member has a doc_id.  Repeated rows stay repeated; other columns are not read.
    """

    rows, member = _members(docs, width, similar)
    of = member.join(member.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", "component_id")
    return rows.select("doc_id", "key").join(of, "key").select("doc_id", "component_id")


def _members(docs: DataFrame, width: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of the set of each row; key, root, first: the component and the first doc_id of each distinct set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                one = shingles(t.as_py(), width)
                least = signature(one)
                out.append((_key(one), len(one), bands(least) if len(one) else [], sketch(least), np.array(fingerprint_of(one), np.uint64).view(np.int64).item()))
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["doc_id", "h", "key", "size", "bands", "sketch", "fp"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(0)]
            yield pa.record_batch([pa.array([_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "found"])

    def frame(keys: np.ndarray, pairs: list[tuple[int, int]], others: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": keys[[a for a, _ in pairs]], "b": others[[b for _, b in pairs]]}, dtype=np.int64)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy()
        return frame(keys, list(similar_links([np.frombuffer(x, np.uint64) for x in pdf["found"]], similar)), keys)

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf[pdf["asks"]]
        sets = [[np.frombuffer(x, np.uint64) for x in part["found"]] for part in (some, pdf[~pdf["asks"]])]
        keys = [part["key"].to_numpy() for part in (some, pdf[~pdf["asks"]])]
        return frame(keys[0], list(crossing_links(*sets, similar)) if all(sets) else [], keys[1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = stash(texts.mapInArrow(sign, "doc_id long, h long, key long, size long, bands array<long>, sketch binary, fp long"), "shingles")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    every = rows.groupBy("key", "size").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    every = stash(every, "signatures")
    band = every.select("key", "size", F.posexplode("bands").alias("turn", "band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    band = band.join(shared, "band").join(every.select("key", "sketch"), "key").select("n", "key", "size", "turn", "band", "sketch")
    band = stash(band.repartition("band").sortWithinPartitions("band").mapInArrow(_promising, "key long, size long, turn int, band long"), "bands")
    near = stash(_near(every.where("size > 0")), "near")
    met = band.select("key").union(near.select("key")).distinct()
    some = texts.join(rows.select("key", "h").distinct().join(met, "key", "left_semi").select("h").distinct(), "h", "left_semi")
    sets = some.select("text").mapInArrow(sets_of, "key long, found binary").join(met, "key", "left_semi")
    found = stash(sets.groupBy("key").agg(F.first("found").alias("found")), "shingle-sets")

    def searched(bucket: DataFrame, known: DataFrame | None) -> DataFrame:
        """Links of the buckets(bucket, key, parts), added to those that are known."""
        part = F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")
        links = stash(bucket.join(found, "key").groupBy("bucket", part).applyInPandas(compare, "a long, b long"), "shingle-links")
        links = links if known is None else known.union(links)
        large = bucket.where("parts > 1")
        return links if large.isEmpty() else links.union(stash(_crossing(large, found, components(links), cross), "crossing-links"))

    links = searched(_buckets(near), None)
    links = searched(_buckets(band, components(links)), links)
    root = components(links).select(F.col("node").alias("key"), "root")
    return rows, stash(first.join(root, "key", "left").withColumn("root", F.coalesce("root", "key")), "shingle-members")


def _near(every: DataFrame, radius: int = RADIUS) -> DataFrame:
    """key, size, band of the sets every(key, size, fp) that are not alone: a band is what links of `radius` bits join."""
    root = components(within(every.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    band = every.join(root, "fp", "left").select("key", "size", F.coalesce("root", "fp").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return band.join(shared.select("band"), "band")


def _buckets(band: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """bucket, key, parts of the band(key, size, band) that two keys share; buckets of the same members count once.

    With known(node, root), only those whose members are in two components.
    """
    rows = band.withColumn("root", F.col("key"))
    if known is not None:
        rows = band.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    alike = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"x{k}") for k in (1, 2)]
    bucket = rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("root").alias("least"), F.max("root").alias("most"), *alike)
    bucket = bucket.where("least <> most").groupBy("n", "x1", "x2").agg(F.min("band").alias("band"), F.max("total").alias("total"))
    parts = F.ceil(F.col("total") / PART).cast("int")
    rows = band.join(bucket.select("band", parts.alias("parts")), "band")
    return stash(rows.select(F.col("band").alias("bucket"), "key", "parts"), "buckets")


def _crossing(large: DataFrame, found: DataFrame, known: DataFrame, cross) -> DataFrame:
    """a, b: links between members of one large bucket(bucket, key, parts) that known(node, root) has in two components.

    Those outside of the bucket's greatest component ask all members; askers and asked are dealt to parts, and every
    part of the one meets every part of the other.
    """
    member = stash(large.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "large")
    count = member.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = count.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    # as many parts of the askers as their share of the members
    shared = main.select("bucket", "main", ((F.col("all") - F.col("n")) / F.col("all")).alias("share"))
    member = member.join(shared, "bucket").withColumn("asked_in", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("parts"))).cast("int")).where("share > 0")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    asks = member.where("root <> main").select("bucket", "key", mine("asked_in").alias("p"), up_to("parts").alias("q"), F.lit(True).alias("asks"))
    asked = member.select("bucket", "key", up_to("asked_in").alias("p"), mine("parts").alias("q"), F.lit(False).alias("asks"))
    pairs = asks.union(asked).join(found, "key").groupBy("bucket", "p", "q").applyInPandas(cross, "a long, b long")
    return pairs.where("a <> b")


def keep_first(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns as they are, with the smallest doc_id of each component of near_duplicates().

    Of rows that repeat a doc_id one stays.  Rows without doc_id can't be told apart and stay.  Which doc_ids these are
    follows from the distinct sets, so that no join has to bring a large group of copies together.
    """
    _, member = _members(docs, width, similar)
    first = member.groupBy("root").agg(F.min("first").alias("doc_id")).where("doc_id is not null")
    return keep_least(docs, first.select("doc_id", F.col("doc_id").alias("component_id")))
