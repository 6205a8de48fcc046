"""SimHash near-duplicates, found with a vantage-point tree over Hamming distance.

Fingerprints are made in Arrow batches and grouped, so that copies count once.
A shallow tree, fitted on a bounded sample, cuts the space into shards: at every
node the distance to the vantage point decides the side.  A fingerprint lives
in one shard and visits each later shard that its ball of `radius` may reach,
by the triangle bound.  In a shard the tree goes on, with vantage points of its
own, down to leaves that are compared in full.  A shard that the sample finds to
be large is compared in parts: every part of those that live there with every
part of those that live there or visit.  A task returns a spanning forest of its
links instead of all pairs, so a large group of near copies stays small; the
forests are joined by components().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._blocks import mix
from ._graph import components, spanning_forest
from ._shared import stash, table

#: Distinct fingerprints on which the shards are fitted, at most.
SAMPLE = 65_536
#: Distinct fingerprints that live in a shard, about, and that live in or visit a part of a shard, about.
PER_SHARD, PER_PART = 8192, 1 << 18
#: Points of the sample that a shard is fitted on, at least.
FITTED = 16
#: A leaf inside a shard; pairs held before they are thinned to a forest; cells compared at once.
LEAF, PAIRS, CELLS = 256, 1 << 20, 1 << 18
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Visits that a task holds before it hands them on.
HELD = 1 << 20


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d separate
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles, given as their hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class ShardTree:
    """The upper vantage-point tree.  Nodes are (vantage, cut, near, far); a shard is its number."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int):
        self.radius, self.shards = radius, 0
        self.root = self._grow(sample, max(shards, 1))

    def _grow(self, points: np.ndarray, shards: int):
        if shards > 1 and (node := best_cut(points, self.radius)):
            vantage, cut = node
            far = np.bitwise_count(points ^ vantage) > cut
            half = min(max(round(shards * (1 - far.mean())), 1), shards - 1)
            return vantage, cut, self._grow(points[~far], half), self._grow(points[far], shards - half)
        self.shards += 1
        return self.shards - 1

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, those that live there, those that visit it), for every shard that any of the points reach.

        A point visits only shards after its own: each pair meets once, where the later of the two lives.
        """
        home = np.full(len(points), -1)
        reached = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, inside = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                home[at[inside]] = node
                reached.append((node, at, inside))
                continue
            vantage, cut, near, far = node
            d = np.bitwise_count(points[at] ^ vantage).astype(np.int16)
            for child, own, reach in ((near, d <= cut, d <= cut + self.radius), (far, d > cut, d > cut - self.radius)):
                todo.append((child, at[reach], (inside & own)[reach]))
        for shard, at, inside in reached:
            yield shard, points[at[inside]], points[at[~inside & (home[at] < shard)]]


def best_cut(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Of a few of the points, the vantage point and the cut that keep the most points clear of the boundary."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, min(len(points), 12)).astype(int)]:
        n = np.bincount(np.bitwise_count(points ^ vantage), minlength=65)
        below = np.cumsum(n)
        for cut in np.flatnonzero((below >= 0.35 * len(points)) & (below <= 0.65 * len(points))):
            doubtful = n[max(cut - radius + 1, 0) : cut + radius + 1].sum()
            if best is None or doubtful < best[0]:
                best = doubtful, vantage, int(cut)
        if best is None and len(np.flatnonzero(n)) > 1:  # one distance holds most points: part it from the rest
            cut = int(np.argmin(np.abs(below[:64] - len(points) / 2)))
            if 0 < below[cut] < len(points):
                best = len(points) + 1, vantage, cut
    return best and best[1:]


def near_pairs(lives: np.ndarray, visits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `radius` apart: the first among `lives`, the second among lives and visits together."""
    points = np.concatenate([lives, visits])
    todo = [(np.arange(len(lives)), np.arange(len(points)))]
    while todo:
        own, asked = todo.pop()
        if not len(own) or not len(asked):
            continue
        cut = best_cut(points[own], radius) if len(own) > LEAF else None
        if cut is None:
            step = max(1, CELLS // len(own))
            for k in range(0, len(asked), step):
                part = asked[k : k + step]
                i, j = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[part]) <= radius)
                i, j = own[i], part[j]
                yield i[i < j], j[i < j]
            continue
        vantage, at = cut
        d_own, d = (np.bitwise_count(points[x] ^ vantage).astype(np.int16) for x in (own, asked))
        todo += [(own[d_own <= at], asked[d <= at + radius]), (own[d_own > at], asked[d > at - radius])]


def forest(lives: np.ndarray, visits: np.ndarray, radius: int, inner: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between lives and visits, and among lives if `inner`, as fingerprints."""
    points = np.concatenate([lives, visits])
    held, n = [], 0
    for a, b in near_pairs(lives, visits, radius):
        if not inner:
            a, b = a[b >= len(lives)], b[b >= len(lives)]
        held.append((a, b))
        n += len(a)
        if n > PAIRS:
            held = [spanning_forest(*map(np.concatenate, zip(*held)), len(points))]
            n = 0
    a, b = spanning_forest(*map(np.concatenate, zip(*held)), len(points)) if held else (np.arange(0),) * 2
    return points[a], points[b]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links among the distinct fingerprints (fp) that connect exactly what lies within `radius`."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp")).select("fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = ShardTree(sample, min(-(-n // PER_SHARD), max(1, len(sample) // FITTED)), radius)
    parts = np.ones((tree.shards, 2), np.int64)  # of those that live in each shard, and of those that visit it
    for shard, lives, visits in tree.route(sample):
        parts[shard] = [max(1, -(-len(x) * n // (len(sample) * PER_PART))) for x in (lives, visits)]

    def tasks(shard: int, lives: np.ndarray, visits: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
        """((shard, part of lives, part they meet), lives, visits): from 0 on for parts of visits, below 0 for parts of lives."""
        m, k = parts[shard].tolist()
        own, other = mix(lives) % np.uint64(m), mix(visits) % np.uint64(k)
        none = lives[:0]
        for p in range(m):
            for q in range(k):
                yield (shard, p, q), lives[own == p], visits[other == q]
            for q in range(p + 1, m):
                yield (shard, p, -q), lives[own == p], none
                yield (shard, p, -q), none, lives[own == q]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[list, list]] = defaultdict(lambda: ([], []))
        n = 0

        def hand_on() -> pa.RecordBatch:
            rows = [(*k, *(b"".join(x.tobytes() for x in part) for part in v)) for k, v in held.items()]
            types = (*[pa.int32()] * 3, pa.binary(), pa.binary())
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["shard", "part", "met", "lives", "visits"])

        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(points), 1 << 14):
                for at in tree.route(points[k : k + (1 << 14)]):
                    for key, lives, visits in tasks(*at):
                        if len(lives) or len(visits):
                            held[key][0].append(lives)
                            held[key][1].append(visits)
                            n += len(lives) + len(visits)
                if n > HELD:
                    yield hand_on()
                    held.clear()
                    n = 0
        if held:
            yield hand_on()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(*(np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("lives", "visits")), radius, pdf["met"].iloc[0] == 0)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "shard int, part int, met int, lives binary, visits binary")
    return routed.groupBy("shard", "part", "met").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for every row of docs.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach.  A null text counts as
    empty; texts without words share fingerprint zero.  A row without doc_id belongs to the component of its
    fingerprint, which is null if no member has a doc_id.  Repeated rows stay repeated; other columns are not read.
    """
    rows = stash(fingerprints(docs, width), "simhash")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    # A fingerprint is known by its first doc_id, so that the smallest node of a component names it; one without any by
    # a number after all of them.
    last = distinct.agg(F.max("first")).first()[0] or 0
    node = F.coalesce("first", F.monotonically_increasing_id() + F.lit(last + 1))
    distinct = stash(distinct.select("fp", node.alias("node")), "simhash-nodes")
    near = links(distinct, radius)
    near = near.join(distinct.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    root = components(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    of = distinct.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    of = of.withColumn("component_id", F.when(F.col("component_id") <= last, F.col("component_id")))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, all columns as they are, with the smallest doc_id of each component of near_duplicates().

    Of rows that repeat a doc_id one stays.  Rows without doc_id can't be told apart and stay.
    """
    return keep_least(docs, near_duplicates(docs, width, radius))


def keep_least(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of docs with the doc_id that names their component in near(doc_id, component_id)."""
    first = near.where("doc_id = component_id").select("doc_id").distinct()
    place = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    known = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    known = known.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where(F.col(place) == 1)
    return known.select(docs.columns).union(docs.where("doc_id is null"))


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
