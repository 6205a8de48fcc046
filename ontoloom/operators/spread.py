"""Scores spread over a graph in blocks, for results that need not hold all of the paths.

A configuration that is spread over a dense graph has a score for nearly every
concept, over several paths each.  As rows of a join these are many times the
graph; here a task takes a block of keys and the tiles of the graph that their
concepts reach, one after the other, and gives only what is asked of each key.
Keys and concepts are dealt by ranges, so that what lies together is sent to few
tasks.  Sums are in order of concepts, however rows come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stash

#: Keys to a block, and to a unit, which no block parts; concepts to a tile; about so many rows are packed, and paths added, at once.
KEYS, UNIT, TILE, ROWS, PATHS = 1024, 64, 1024, 1 << 20, 1 << 21
#: Concepts to a pane, which measured() meets with all keys; cells that are held at once.
PANE, CELLS = 1 << 15, 1 << 17
#: Where a row of a block holds keys, and no tile; the key of rows without one.
OWN, NONE = -1 << 62, -1 << 61


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    if x.dtype.kind == "f" or not len(x):
        return x
    least, most = int(x.min()), int(x.max())
    return x.astype(next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def packed(**columns: np.ndarray) -> bytes:
    batch = pa.record_batch([pa.array(_narrow(c)) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes, wide: bool = True) -> dict[str, np.ndarray]:
    """The columns; whole numbers are long, or as they were packed."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    cols = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(table.column_names, table.itercolumns())}
    return {n: c.astype(np.int64) if wide and c.dtype.kind != "f" else c for n, c in cols.items()}


def in_order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by their columns, the first one first."""
    if len(columns) == 2 and len(columns[0]) and all(0 <= c.min() and c.max() < 1 << 31 for c in columns):
        return np.argsort(columns[0] << 32 | columns[1], kind="stable")
    return np.lexsort(columns[::-1])


def opens(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the row before."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of n), each pair once, in order of b and a."""
    order = in_order(b, a)
    a, b, n = a[order], b[order], n[order]
    at = opens(b, a)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of the batches, about so many rows at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).itercolumns()]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).itercolumns()]


def _pairs(values: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (a, b) of one group, both ways and with itself, some paths at once."""
    first = np.repeat(np.cumsum(length) - length, length)  # of the group of each value
    of = np.repeat(length, length)
    total = np.cumsum(of)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PATHS, "right")))
        n = of[at:to]
        yield values[np.repeat(first[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(values[at:to], n)
        at = to


def _dealt_pairs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """tile, data: how often each two concepts share a group, by tiles of one of them."""

    def hand_on(held: list) -> pa.RecordBatch:
        a, b, n = _added(*(np.concatenate([h[j] for h in held]) for j in range(3)))
        at = opens(b // width)
        data = [packed(a=a[i:j], b=b[i:j] % width, n=n[i:j]) for i, j in zip(at, [*at[1:], len(b)])]
        return pa.record_batch([pa.array(b[at] // width), pa.array(data, pa.binary())], names=["tile", "data"])

    held, n = [], 0
    for batch in batches:
        own = batch.column("own").drop_null()
        values = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in _pairs(values, own.value_lengths().to_numpy().astype(np.int64)):
            held.append(_added(a, b, np.ones(len(a), np.int64)))
            n += len(held[-1][0])
            if n >= 4 * ROWS:
                yield hand_on(held)
                held, n = [], 0
    if n:
        yield hand_on(held)


def _tiled(edges: DataFrame, width: int) -> tuple[DataFrame, Callable[[pa.Table], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]]:
    """(rows with the tile they belong to, what reads all rows of a tile as a, b less the tile's first, and n or score)."""
    if edges.columns == ["own"]:

        def counts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
            parts = [unpacked(x.as_py()) for x in t["data"]]
            a, b, n = _added(*(np.concatenate([p[c] for p in parts]) for c in "abn"))
            return a, b, {"n": n}

        return edges.mapInArrow(lambda batches: _dealt_pairs(batches, width), "tile long, data binary"), counts
    e = edges.where("src <> dst")  # none without an end
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "score").union(e.select("dst", "src", "score"))
    both = both.withColumn("tile", F.floor(F.col("b") / width).cast("long")).repartition("tile").groupBy("tile", "b", "a").agg(F.avg("score").alias("score"))

    def scores(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        b, a, score = (t[c].to_numpy() for c in ("b", "a", "score"))
        own = np.unique(b)
        a, b, score = np.concatenate([a, own]), np.concatenate([b, own]), np.concatenate([score, np.ones(len(own))])
        order = in_order(b, a)
        return a[order], b[order] % width, {"score": score[order]}

    return both, scores


def tiles(edges: DataFrame) -> DataFrame:
    """tile, reached, graph: the normalised graph of edges(src, dst, score) by ranges of one end, with the ranges of the others.

    Instead of edges there may be groups(own), arrays of distinct concepts: two that share n groups have an edge of
    n / (n + 1).  See graph_of() for what a tile holds.
    """
    width = TILE
    rows, read = _tiled(edges, width)

    def pack(t: pa.Table) -> pa.Table:
        a, b, more = read(t)
        return row(t, width, a, b, **more)

    return rows.groupBy("tile").applyInArrow(pack, "tile long, reached array<long>, graph binary")


def panes(edges: DataFrame, y: DataFrame, code: dict) -> DataFrame:
    """pane, first, reached, graph, y: the graph of tiles() by wide ranges of one end, laid out by the other, from the first one on.

    y has those of y(concept, u, w) whose concept is in the pane, with the codes of their u.
    """
    width = PANE
    rows, read = _tiled(edges, width)
    names = ["pane", "first", "reached", "graph", "y"]

    def pack(t: pa.Table, y: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())], names=names)
        a, b, more = read(t)
        order = in_order(a, b)
        a, b, more = a[order], b[order], {n: c[order] for n, c in more.items()}
        data = [packed(step=np.diff(a, prepend=a[:1]), b=b, **more)]
        c, u, w = y["concept"].to_numpy(), np.array([code[z] for z in y["u"].to_pylist()], np.int64), y["w"].to_numpy()
        order = in_order(c, u)
        data.append(packed(c=c[order] % width, u=u[order], w=w[order]))
        reached = pa.array([np.unique(a // width).tolist()], pa.list_(pa.int64()))
        return pa.table([t["tile"].slice(0, 1), pa.array(a[:1]), reached, *(pa.array([d], pa.binary()) for d in data)], names=names)

    by_pane = y.withColumn("pane", F.floor(F.col("concept") / width).cast("long")).groupBy("pane")
    return rows.groupBy("tile").cogroup(by_pane).applyInArrow(pack, "pane long, first long, reached array<long>, graph binary, y binary")


def row(t: pa.Table, width: int, a: np.ndarray, b: np.ndarray, **more: np.ndarray) -> pa.Table:
    reached = pa.array([np.unique(a // width).tolist()], pa.list_(pa.int64()))
    return pa.table([t["tile"].slice(0, 1), reached, pa.array([packed(a=a, b=b, **more)], pa.binary())], names=["tile", "reached", "graph"])


def graph_of(tile: int, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score, size) of a tile: for each edge of its concepts the other end, the concept, the mean score, and how
    many edges the concept has; loops of score 1 are included, concepts without other edges are not."""
    x = unpacked(data)
    a, local = x["a"], x["b"]
    b = local + tile * width
    size = np.bincount(local, minlength=width)[local]
    score = x["score"] if "score" in x else np.where(a == b, 1.0, x["n"] / (x["n"] + 1.0))
    some = size > 1
    return a[some], b[some], score[some], size[some]


def seats(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that repartition() by a long column puts there."""
    found: dict[int, int] = {}
    many = 16 * n
    while len(found) < n:
        rows = spark.range(many).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
        found, many = {r["at"]: r["id"] for r in rows}, many * 4
    return [found[i] for i in range(n)]


def units(x: DataFrame, width: int | None = None) -> DataFrame:
    """unit, ks, ats, data: rows of x(k, concept, ...) packed by ranges of keys, with their keys and the tiles of their concepts."""
    names, width = x.columns, width or TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in in_slices(batches, ROWS):
            order = in_order(*cols[:2])
            cols = [c[order] for c in cols]
            unit = cols[0] // UNIT
            at = opens(unit)
            parts = [[c[i:j] for c in cols] for i, j in zip(at, [*at[1:], len(unit)])]
            ids = [pa.array([np.unique(p[c] // d).tolist() for p in parts], pa.list_(pa.int64())) for c, d in ((0, 1), (1, width))]
            data = pa.array([packed(**dict(zip(names, p))) for p in parts], pa.binary())
            yield pa.record_batch([pa.array(unit[at]), *ids, data], names=["unit", "ks", "ats", "data"])

    return x.mapInArrow(run, "unit long, ks array<long>, ats array<long>, data binary")


def in_blocks(own: DataFrame, least: int = 1) -> tuple[DataFrame, int]:
    """(units with the block of each, how many blocks); a block stands in a partition of its own."""
    keys = own.select(F.explode("ks").alias("k")).distinct().select(F.floor(F.col("k") / UNIT).cast("long").alias("unit"))
    n = max(least, -(-keys.count() // KEYS))
    cuts = sorted(set(keys.approxQuantile("unit", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    n = len(cuts) + 1
    at = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("unit"))) if cuts else F.lit(0)
    return own.withColumn("block", F.get(F.array(*(F.lit(i).cast("long") for i in seats(own.sparkSession, n))), at)), n


class Held:
    """Keys, some given or all that occur, with what they hold, in order."""

    def __init__(self, parts: list[dict[str, np.ndarray]], keys: np.ndarray | None = None, columns: tuple[str, ...] = ("k", "concept", "score")):
        cols = {c: np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) if c in ("k", "concept") else np.concatenate([np.zeros(0), *(p[c] for p in parts)]) for c in columns}
        order = in_order(cols["k"], cols["concept"])
        cols = {c: x[order] for c, x in cols.items()}
        k, self.concept, self.score, self.weight = cols["k"], cols["concept"], cols["score"], cols.get("weight")
        self.keys = k[opens(k)] if keys is None else keys
        self.starts = np.append(np.searchsorted(k, self.keys), len(k))
        self.row = np.repeat(np.arange(len(self.keys)), np.diff(self.starts))
        self.kinds, self.place = np.unique(self.concept, return_inverse=True)

    def near(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges whose end `a` the block holds, in order of it; where those of each kind start, and the last end)."""
        if not len(self.kinds):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        at = np.searchsorted(self.kinds, a)
        at[at == len(self.kinds)] = 0
        some = np.flatnonzero(self.kinds[at] == a)
        some = some[np.argsort(at[some], kind="stable")]
        return some, np.searchsorted(at[some], np.arange(len(self.kinds) + 1))

    def paths(self, near: np.ndarray, width: int, lo: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first key, last and one, x of each path, edge of each path) for some keys at once."""
        n = near[self.place + 1] - near[self.place]
        total = np.concatenate([[0], np.cumsum(n)])
        by_key, last = total[self.starts], len(self.keys) if last is None else last
        while lo < last:
            hi = int(np.searchsorted(by_key, by_key[lo] + PATHS, "right")) - 1
            hi = min(max(lo + 1, hi), lo + max(1, 2 * PATHS // width), last)
            i, j = self.starts[lo], self.starts[hi]
            if total[j] > total[i]:
                x = np.repeat(np.arange(i, j), n[i:j])
                yield lo, hi, x, np.arange(len(x)) + (near[self.place[i:j]] - total[i:j] + total[i])[x - i]
            lo = hi


class Block(Held):
    """Keys with their scores of concepts, and what they are spread over so far, tile by tile."""

    def __init__(self, parts: list[dict[str, np.ndarray]], ratio: float, width: int):
        super().__init__(parts)
        self.width, self.ratio, self.top, self.tiles = width, ratio, np.full(len(self.keys), -np.inf), []

    def add(self, tile: int, data: bytes) -> None:
        a, b, e, size = graph_of(tile, data, self.width)
        some, near = self.near(a)
        if not len(some):
            return
        e, size = e[some], size[some]
        ends, local = np.unique(b[some], return_inverse=True)
        positive = (self.score > 0).all() and (e > 0).all()
        rows, cols, scores = [], [], []
        for lo, hi, x, edge in self.paths(near, len(ends)):
            at = (self.row[x] - lo) * len(ends) + local[edge]
            v = np.bincount(at, self.score[x] * e[edge] / size[edge], (hi - lo) * len(ends))
            seen = v > 0 if positive else np.bincount(at, minlength=len(v)) > 0
            v, seen = v.reshape(hi - lo, -1), seen.reshape(hi - lo, -1)
            self.top[lo:hi] = np.maximum(self.top[lo:hi], np.where(seen, v, -np.inf).max(axis=1))
            r, c = np.nonzero(seen & (v >= self.ratio * self.top[lo:hi, None]))  # the greatest only grows
            rows.append((r + lo).astype(np.int32)), cols.append(c.astype(np.uint16)), scores.append(v[r, c])
        if rows:
            rows = np.concatenate(rows)
            self.tiles.append((np.searchsorted(rows, np.arange(len(self.keys) + 1)), np.concatenate(cols), np.concatenate(scores), ends))

    def found(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(key less lo, which end, score, ends) of the strong scores of some keys, tile by tile."""
        for starts, cols, scores, ends in self.tiles:
            r = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            c, v = cols[starts[lo] : starts[hi]], scores[starts[lo] : starts[hi]]
            strong = v >= self.ratio * self.top[lo:hi][r]
            yield r[strong], c[strong], v[strong], ends


def _whole_rows(x: DataFrame, key: str) -> DataFrame:
    """k, concept, score of x(key, concept, score), as long and double, without rows that lack any but the key."""
    return x.select(F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("k"), F.col("concept").cast("long").alias("concept"), F.col("score").cast("double").alias("score")).na.drop()


def spread(x: DataFrame, key: str, edges: DataFrame, ratio: float = 0.05) -> DataFrame:
    """key, concept, score: x(key, concept, score) spread over the graph of edges, or of groups; see tiles().

    Scores under `ratio` of the greatest of their key go.  Keys and concepts are whole numbers.
    """
    graph = stash(tiles(edges), "spread-tiles")
    own, n = in_blocks(stash(units(_whole_rows(x, key)), "spread-x"))
    meets = graph.select("tile", F.explode("reached").alias("at")).join(own.select("block", F.explode("ats").alias("at")).distinct(), "at").select("block", "tile").distinct()
    rows = own.select("block", F.lit(OWN).cast("long").alias("tile"), "data").union(meets.join(graph, "tile").select("block", "tile", "graph"))
    width = TILE

    def result(block: Block) -> Iterator[pa.RecordBatch]:
        step = 64
        for lo in range(0, len(block.keys), step):
            for r, c, v, ends in block.found(lo, min(lo + step, len(block.keys))):
                yield pa.record_batch([pa.array(block.keys[lo + r]), pa.array(ends[c]), pa.array(v)], names=["k", "concept", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            for b, t, data in zip(*(batch.column(c) for c in ("block", "tile", "data"))):
                if b.as_py() != at:
                    if block:
                        yield from result(block)
                    at, parts, block = b.as_py(), [], None
                if t.as_py() == OWN:
                    parts.append(unpacked(data.as_py()))
                    continue
                block = block or Block(parts, ratio, width)
                block.add(t.as_py(), data.as_py())
        if block:
            yield from result(block)

    out = rows.repartition(n, "block").sortWithinPartitions("block", "tile").mapInArrow(run, "k long, concept long, score double")
    return out.select(_keyed(x, key), F.col("concept").cast(x.schema["concept"].dataType), "score")


def _keyed(x: DataFrame, key: str) -> Column:
    return F.when(F.col("k") != NONE, F.col("k")).cast(x.schema[key].dataType).alias(key)


class Ends:
    """Where the edges of each end are, edges being in order of it."""

    def __init__(self, a: np.ndarray):
        at = opens(a) if len(a) else np.zeros(0, np.int64)
        self.kinds, self.starts, self.table = a[at], np.append(at, len(a)), None
        if len(at) and self.kinds[-1] - self.kinds[0] <= 8 * len(a) + (1 << 16):  # none are before and behind them
            n = np.zeros(int(self.kinds[-1] - self.kinds[0]) + 3, np.int64)
            n[self.kinds - self.kinds[0] + 1] = np.diff(self.starts)
            self.table = np.concatenate([[0], np.cumsum(n)])

    def edges(self, concept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the edges of each concept start, how many they are)."""
        if not len(self.kinds):
            return np.zeros(len(concept), np.int64), np.zeros(len(concept), np.int64)
        if self.table is not None:
            at = np.clip(concept - (self.kinds[0] - 1), 0, len(self.table) - 2)
            first = self.table[at]
            return first, self.table[at + 1] - first
        at = np.minimum(np.searchsorted(self.kinds, concept), len(self.kinds) - 1)
        return self.starts[at], np.where(self.kinds[at] == concept, self.starts[at + 1] - self.starts[at], 0)


class Pane(Ends):
    """A pane of panes(), laid out for keys to be spread over: edges in order of their end `a`."""

    def __init__(self, pane: int, first: int, data: bytes, width: int, usual: float):
        x = unpacked(data, wide=False)
        a, b = first + np.cumsum(x["step"], dtype=np.int64), x["b"]
        size = np.bincount(b, minlength=width)
        n = x["score"] if "score" in x else x["n"]
        if (size == 1).any():  # concepts without other edges
            some = size[b] > 1
            a, b, n = a[some], b[some], n[some]
        self.b, self.n, self.size, self.width, self.low = b, n, size.astype(float), width, pane * width
        self.counted, self.usual, self.layers = "n" in x, usual, None
        self.positive = self.counted or bool((n > 0).all())
        self.weight = n / (n + 1.0) if self.counted else n.copy()
        self.weight[np.flatnonzero(a == b.astype(np.int64) + self.low)] = 1.0
        self.weight *= usual
        self.weight /= self.size[b]
        super().__init__(a)

    def paths(self, starts: np.ndarray, concept: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(keys that have paths, paths of each, end of each path, what it adds, the whole score at its end) for some keys at once.

        starts has where the holdings of each key start, and their number.  Sums are in order of holdings.
        """
        first, n = self.edges(concept)
        odd = np.flatnonzero(score != self.usual)
        total = np.concatenate([[0], np.cumsum(n)])
        by_key, lo, last = total[starts], 0, len(starts) - 1
        while lo < last:
            hi = int(np.searchsorted(by_key, by_key[lo] + PATHS, "right")) - 1
            hi = min(max(lo + 1, hi), lo + max(1, CELLS // self.width), last)
            i, j = starts[lo], starts[hi]
            if total[j] > total[i]:
                m = n[i:j]
                edge = np.repeat(first[i:j] - total[i:j] + total[i], m) + np.arange(total[j] - total[i])
                each = np.diff(by_key[lo : hi + 1])
                end, adds = self.b[edge], self.weight[edge]
                h = odd[slice(*np.searchsorted(odd, (i, j)))]
                if len(h):
                    p = np.repeat(total[h] - total[i] - np.cumsum(n[h]) + n[h], n[h]) + np.arange(n[h].sum())
                    e = self.n[edge[p]] / (self.n[edge[p]] + 1.0) if self.counted else self.n[edge[p]]
                    e = np.where(np.repeat(concept[h], n[h]) == end[p].astype(np.int64) + self.low, 1.0, e)
                    adds[p] = np.repeat(score[h], n[h]) * e / self.size[end[p]]
                cell = np.repeat(np.arange(hi - lo) * self.width, each) + end  # few at once, so that they stay in a processor's cache
                some = np.flatnonzero(each)
                yield lo + some, each[some], end, adds, np.bincount(cell, adds, (hi - lo) * self.width)[cell]
            lo = hi


def _holdings(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, where their holdings start and how many there are, concepts, scores) of a unit."""
    x = unpacked(data)
    at = opens(x["k"])
    return x["k"][at], np.append(at, len(x["k"])), x["concept"], x["score"]


def _whole_units(own: DataFrame, n: int) -> DataFrame:
    """unit, ats, data: each unit of units() with a block in one row, in order of keys and concepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ats = None, [], set()

        def whole() -> pa.RecordBatch:
            cols = [np.concatenate([p[c] for p in parts]) for c in ("k", "concept", "score")]
            order = in_order(*cols[:2])
            data = packed(**dict(zip(("k", "concept", "score"), (c[order] for c in cols))))
            return pa.record_batch([pa.array([at]), pa.array([sorted(ats)], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["unit", "ats", "data"])

        for batch in batches:
            for u, near, data in zip(*(batch.column(c) for c in ("unit", "ats", "data"))):
                if u.as_py() != at:
                    if parts:
                        yield whole()
                    at, parts, ats = u.as_py(), [], set()
                parts.append(unpacked(data.as_py()))
                ats.update(near.as_py())
        if parts:
            yield whole()

    return own.repartition(n, "block").sortWithinPartitions("unit").select("unit", "ats", "data").mapInArrow(run, "unit long, ats array<long>, data binary")


@contextmanager
def _sparing(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, batches of packed rows are of 16 MB instead of 64, and what was exchanged goes when it is stashed."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _met(own: DataFrame, n: int, graph: DataFrame, schema: str, start: Callable, visit: Callable, end: Callable) -> DataFrame:
    """What is found when each unit of own(unit, ats, data, more) meets each pane of graph(..., y), with no exchange of either.

    A task takes some panes and some of the n blocks of units, and reads both from where they were stashed: it gets
    units with its first pane, and panes with its first unit.  start(holdings, more) gives what visit(held, holdings,
    pane, y) adds to for each pane that the unit reaches; end(held, holdings) gives the columns of its row, if any,
    after the unit and a number for the task's panes.
    """
    side, width = math.ceil(math.sqrt(own.sparkSession.sparkContext.defaultParallelism)), PANE
    first = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) == 0
    left = graph.coalesce(3 * side).select("*", first.alias("leads"), F.spark_partition_id().alias("part"))
    right = own.coalesce(max(side, -(-n // 16))).select("*", first.alias("heads"))
    ours, theirs = ("unit", "ats", "data", "more"), ("pane", "first", "reached", "graph", "y")
    sent = left.hint("shuffle_replicate_nl").crossJoin(right).where("leads or heads")
    sent = sent.select("part", *(F.when(F.col("leads"), F.col(c)).alias(c) for c in ours), *(F.when(F.col("heads"), F.col(c)).alias(c) for c in theirs))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waits, part, usual = [], None, None, None

        def meet(pane: int, first: int, reached: list[int], data: bytes, y: bytes | None) -> None:
            nonlocal usual
            met = [(holdings, held) for _, ats, holdings, held in own if not ats.isdisjoint(reached)]
            if met and usual is None:
                values, times = np.unique(_holdings(met[0][0])[3], return_counts=True)
                usual = float(values[times.argmax()])
            laid, y = Pane(pane, first, data, width, usual) if met else None, unpacked(y) if y else None
            for holdings, held in met:
                visit(held, _holdings(holdings), laid, y)

        for batch in batches:
            part = batch.column("part")[0].as_py()
            for *unit, pane, first, reached, edges, y in zip(*(batch.column(c) for c in ours + theirs)):
                if pane.is_valid:
                    if waits:  # for units, which come with the first pane
                        meet(*waits)
                    waits = pane.as_py(), first.as_py(), reached.as_py(), edges.as_py(), y.as_py()
                if unit[0].is_valid:
                    k, ats, data, more = (c.as_py() for c in unit)
                    own.append((k, set(ats), data, start(_holdings(data), more)))
        if waits:
            meet(*waits)
        for k, _, holdings, held in own:
            columns = end(held, _holdings(holdings))
            if columns:
                yield pa.record_batch([pa.array([k]), pa.array([part], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=names)

    return sent.mapInArrow(run, schema)


def measured(x: DataFrame, key: str, y: DataFrame, other: str, edges: DataFrame, ratio: float = 0.05) -> DataFrame:
    """key, other, dot, norm of x(key, concept, score) spread over the graph of edges and of y(other, concept, score).

    Spread scores under `ratio` of the greatest of their key go.  dot is the product of what the two have in common; a
    row without `other` has the norm of a key.  Keys and concepts are whole numbers.  Scores are made twice, for the
    greatest of each key and for what is asked of them, so that none is held, and the graph and the keys are read from
    where they were stashed, so that neither is sent to all parts of the other.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    y, width = y.where("concept is not null and score is not null"), PANE
    codes = [r[0] for r in y.select(other).distinct().orderBy(other).collect()]
    kind, utype, many = y.schema[other].dataType.simpleString(), to_arrow_type(y.schema[other].dataType), max(1, len(codes))
    code = {u: i for i, u in enumerate(codes)}

    ys = y.select(F.col("concept").cast("long").alias("concept"), F.col(other).alias("u"), F.col("score").cast("double").alias("w"))
    with _sparing(y.sparkSession):
        graph = stash(panes(edges, ys, code), "spread-panes")
        blocks, n = in_blocks(stash(units(_whole_rows(x, key), width), "spread-x"), math.ceil(math.sqrt(y.sparkSession.sparkContext.defaultParallelism)))
        own = stash(_whole_units(blocks, n), "spread-units")

    def greatest(top: np.ndarray, holdings: tuple, pane: Pane, _: dict | None) -> None:
        for some, each, _, _, v in pane.paths(*holdings[1:]):
            top[some] = np.maximum(top[some], np.maximum.reduceat(v, np.cumsum(each) - each))

    def of_all(t: pa.Table) -> pa.Table:
        top = np.maximum.reduce([unpacked(z.as_py())["top"] for z in t["data"]])
        return pa.table([t["unit"].slice(0, 1), pa.array([packed(top=top)], pa.binary())], names=["unit", "more"])

    tops = _met(own.withColumn("more", F.lit(None).cast("binary")), n, graph.withColumn("y", F.lit(None).cast("binary")), "unit long, part int, data binary",
                lambda holdings, _: np.full(len(holdings[0]), -np.inf), greatest, lambda top, _: (packed(top=top),) if (top > -np.inf).any() else None)

    def asked(held: dict, holdings: tuple, pane: Pane, y: dict) -> None:
        if pane.layers is None:
            at = opens(y["c"]) if len(y["c"]) else np.zeros(0, np.int64)
            rank, pane.layers = np.arange(len(y["c"])) - np.repeat(at, np.diff(np.append(at, len(y["c"])))), []
            for r in range(int(rank.max(initial=-1)) + 1):  # of each end one code at once
                u, w, of = np.full(width, many), np.zeros(width), rank == r
                u[y["c"][of]], w[y["c"][of]] = y["u"][of], y["w"][of]
                pane.layers.append((u, w))
        limit, positive = ratio * held["top"], pane.positive and bool((holdings[3] > 0).all()) and bool((y["w"] > 0).all())
        for some, each, end, adds, v in pane.paths(*holdings[1:]):
            strong = v >= np.repeat(limit[some], each)
            adds = np.where(strong, adds, 0.0)  # the square of a score is what its paths add, times the score
            held["norm"][some] += np.add.reduceat(adds * v, np.cumsum(each) - each)
            row = np.repeat(np.arange(len(some)) * (many + 1), each)
            for u, w in pane.layers:
                cell = row + u[end]
                of = lambda weight: np.bincount(cell, weight, len(some) * (many + 1)).reshape(-1, many + 1)[:, :many]  # noqa: B023, E731
                dot = of(adds * w[end])
                held["dot"][some] += dot
                held["seen"][some] |= dot > 0 if positive else of(strong) > 0

    def begun(holdings: tuple, more: bytes) -> dict:
        m = len(holdings[0])
        return {"top": unpacked(more)["top"], "norm": np.zeros(m), "dot": np.zeros((m, many)), "seen": np.zeros((m, many), bool)}

    def found(held: dict, holdings: tuple) -> tuple[bytes, bytes]:
        return packed(k=holdings[0], top=held["top"], norm=held["norm"]), packed(dot=held["dot"].ravel(), seen=held["seen"].ravel().astype(np.int64))

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        keys, cells = [unpacked(z.as_py()) for z in t["keys"]], [unpacked(z.as_py()) for z in t["cells"]]
        dot, norm, some = sum(c["dot"] for c in cells), sum(c["norm"] for c in keys), np.flatnonzero(sum(c["seen"] for c in cells))
        has = np.flatnonzero(keys[0]["top"] > -np.inf)
        k = keys[0]["k"][np.concatenate([some // many, has])]
        u = pa.array([codes[i] for i in (some % many).tolist()] + [None] * len(has), utype)
        none = lambda m: pa.nulls(m, pa.float64())
        return pa.table([pa.array(k), u, pa.concat_arrays([pa.array(dot[some]), none(len(has))]), pa.concat_arrays([none(len(some)), pa.array(np.sqrt(np.maximum(norm[has], 0)))])], names=["k", "u", "dot", "norm"])

    with _sparing(y.sparkSession):
        tops = stash(tops.groupBy("unit").applyInArrow(of_all, "unit long, more binary"), "spread-tops")
        met = _met(stash(own.join(tops, "unit"), "spread-topped"), n, graph, "unit long, part int, keys binary, cells binary", begun, asked, found)
        out = stash(met.groupBy("unit").applyInArrow(added, f"k long, u {kind}, dot double, norm double"), "spread-measured")
    return out.select(_keyed(x, key), F.col("u").alias(other), "dot", "norm")
