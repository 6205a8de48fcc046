"""Link prediction between two kinds of nodes by weighted Jaccard indices over two-hop paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from ..sources.store import stash
from . import spread
from .configuration import counted


def _mass(edges: DataFrame, weights: DataFrame, end: str, by: str, name: str) -> DataFrame:
    """For each node `by`, the sum over its edges of the root of edge score times the weight of the other end."""
    w = weights.select(F.col("id").alias(end), F.col("weight").alias("_w"))
    return edges.join(w, end, "left").groupBy(by).agg(F.sum(F.sqrt(F.coalesce("_w", F.lit(0.0)) * F.col("score"))).alias(name))


def _paths(first: DataFrame, second: DataFrame, weights: DataFrame, near: str, far: str) -> DataFrame:
    """Two-hop paths, summed for each pair of ends: root of pivot weight times the first and the second edge."""
    a = first.select("src", F.col("dst").alias("pivot"), F.col("score").alias("_a"))
    b = second.select(F.col("src").alias("pivot"), "dst", F.col("score").alias("_b"))
    w = weights.select(F.col("id").alias("pivot"), F.col("weight").alias("_w"))
    root = lambda c: F.sum(F.sqrt(F.coalesce("_w", F.lit(0.0)) * F.col(c)))
    return a.join(b, "pivot").join(w, "pivot", "left").groupBy("src", "dst").agg(root("_a").alias(near), root("_b").alias(far))


def jaccard(left_weights: DataFrame, right_weights: DataFrame, left_left: DataFrame, left_right: DataFrame, right_right: DataFrame, least: float = 0.01) -> DataFrame:
    """Scored candidate links of left to right nodes.

    The weights are (id, weight), the edges (src, dst, score).  Candidates are the ends of paths left-left-right and
    left-right-right.  The intersection is half the sum of the four path terms; what the two neighbourhoods have beyond
    their paths is lateral.  jaccard_000 is the intersection's share of both; jaccard_100 weighs it by the root of the
    node weights, jaccard_010 by the known link, jaccard_110 by both.  Links under `least` in jaccard_110 go.
    """
    one = _paths(left_left, left_right, left_weights, "i_int_l", "c_int_l")
    two = _paths(left_right, right_right, right_weights, "i_int_r", "c_int_r")
    pairs = one.join(two, ["src", "dst"], "full_outer")
    pairs = pairs.join(left_right.withColumnRenamed("score", "link"), ["src", "dst"], "left")
    for weights, end, name in ((left_weights, "src", "src_weight"), (right_weights, "dst", "dst_weight")):
        pairs = pairs.join(weights.select(F.col("id").alias(end), F.col("weight").alias(name)), end, "left")
    for edges, weights, end, by, name in (
        (left_left, left_weights, "dst", "src", "i_left_l"),
        (left_right, left_weights, "src", "dst", "c_right_l"),
        (left_right, right_weights, "dst", "src", "i_left_r"),
        (right_right, right_weights, "src", "dst", "c_right_r"),
    ):
        pairs = pairs.join(_mass(edges, weights, end, by, name), by, "left")
    pairs = pairs.fillna(0)
    lateral = [("i_left_l", "i_int_l"), ("c_right_l", "c_int_l"), ("i_left_r", "i_int_r"), ("c_right_r", "c_int_r")]
    for outer, inner in lateral:
        pairs = pairs.withColumn(outer, F.greatest(F.lit(0.0), F.col(outer) - F.col(inner)))
    inner = sum((F.col(i) for _, i in lateral[1:]), F.col(lateral[0][1])) / 2
    outer = sum((F.col(o) for o, _ in lateral[1:]), F.col(lateral[0][0]))
    nodes, known = F.sqrt(F.col("src_weight") * F.col("dst_weight")), (F.col("link") + 1) / 2
    pairs = pairs.withColumn("jaccard_000", safe_div(inner, inner + outer))
    pairs = pairs.withColumn("jaccard_100", F.col("jaccard_000") * nodes).withColumn("jaccard_010", F.col("jaccard_000") * known)
    return pairs.withColumn("jaccard_110", F.col("jaccard_100") * known).where(F.col("jaccard_110") >= least)


def _dealt(df: DataFrame, width: int) -> DataFrame:
    """tile, data: rows of df(b, ...) packed by tiles of b."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in spread.in_slices(batches, spread.ROWS):
            order = spread.in_order(*cols[:2])
            cols = [c[order] for c in cols]
            tile = cols[0] // width
            at = spread.opens(tile)
            data = [spread.packed(**{n: c[i:j] for n, c in zip(names, cols)}) for i, j in zip(at, [*at[1:], len(tile)])]
            yield pa.record_batch([pa.array(tile[at]), pa.array(data, pa.binary())], names=["tile", "data"])

    return df.mapInArrow(run, "tile long, data binary")


def _masses(by: np.ndarray, weight: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(by, np.sqrt(weight * score), n)


def _by_end(a: np.ndarray, **more: np.ndarray) -> bytes:
    """Edges in order of their end `a`, packed."""
    return int(a[0] if len(a) else 0).to_bytes(8, "little", signed=True) + spread.packed(step=np.diff(a, prepend=a[:1]), **more)


def _ends(data: bytes) -> dict[str, np.ndarray]:
    x = spread.unpacked(data[8:], wide=False)
    return x | {"a": int.from_bytes(data[:8], "little", signed=True) + np.cumsum(x.pop("step"), dtype=np.int64)}


#: What a unit gets of its own besides the links: edges among the left, and their weights.
LEFT, WEIGHTS = spread.OWN + 1, spread.OWN + 2
#: Right nodes to a tile; left nodes to a range of which a tile tells whether it has them.
WIDTH, RANGE = 1 << 14, 1 << 10
#: Sums of single precision, or in another order, differ by less than this share.
SLACK = 1e-5


class Unit:
    """Left nodes, packed: what each is linked to on the left and on the right."""

    @staticmethod
    def packed(parts: dict[int, list[dict[str, np.ndarray]]]) -> tuple[bytes, bytes, bytes]:
        """(the nodes, their left edges, their links) in order of nodes and other ends."""
        keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(p["k"] for kind in (spread.OWN, LEFT) for p in parts[kind])]))
        weight, out, own = np.zeros(len(keys)), [], {"k": keys}
        for p in parts[WEIGHTS]:
            known = np.flatnonzero(np.isin(p["k"], keys))
            weight[np.searchsorted(keys, p["k"][known])] = p["weight"][known]
        for kind, name in ((LEFT, "left"), (spread.OWN, "right")):
            h = spread.Held(parts[kind], keys, ("k", "concept", "score", "weight"))
            own |= {f"n_{name}": np.diff(h.starts), f"m_{name}": _masses(h.row, h.weight, h.score, len(keys))}
            out.append(spread.packed(concept=h.concept, score=h.score, weight=h.weight))
        return spread.packed(**own, weight=weight), *out

    def __init__(self, own: bytes, left: bytes, right: bytes):
        x = spread.unpacked(own)
        self.keys, self.weight, self.mass, self.ways = x["k"], x["weight"], (x["m_left"], x["m_right"]), []
        for name, data in (("left", left), ("right", right)):
            y = spread.unpacked(data)
            starts = np.concatenate([[0], np.cumsum(x[f"n_{name}"])])
            self.ways.append((starts, y["concept"], y["score"], y["weight"], np.sqrt(y["weight"] * y["score"]), np.sqrt(y["weight"])))


class Tile:
    """Right nodes: the edges among them and the links to them, in order of the other end."""

    def __init__(self, tile: int, width: int, data: bytes, held: bytes, weight: bytes, mass: bytes | None):
        self.low, self.width, self.weight, self.reached = tile * width, width, spread.unpacked(weight)["weight"], np.zeros(width)
        if mass:
            m = spread.unpacked(mass)
            self.reached[m["a"] % width] = m["m"]
        links, graph = _ends(held), _ends(data)
        self.holders = _masses(links["b"], links["weight"], links["score"], width)
        self.ways = [(spread.Ends(x["a"]), x["b"], e, np.sqrt(e).astype(np.float32)) for x, e in ((links, links["score"]), (graph, graph["n"] / (graph["n"] + 1.0)))]

    def links(self, unit: Unit, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(src, dst, the four scores) of the links of a unit to the tile, some left nodes at once.

        The four sums over paths are made only where the sum of all of them can be enough: a share of `least` or more,
        weighed by the greatest weights there are, takes a part of what the left node has around it.
        """
        width, score = self.width, unit.ways[1][2]
        known = (score.max(initial=0.0) + 1) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            share = least / (np.sqrt(unit.weight * self.weight.max(initial=0.0)) * known)
            need = np.where(share <= 1 + SLACK, 2 * share / (1 + share) * sum(unit.mass) * (1 - SLACK), np.inf)
        found = [end.edges(way[1]) for way, (end, *_) in zip(unit.ways, self.ways)]
        total = [np.concatenate([[0], np.cumsum(n)]) for _, n in found]
        by_key = sum(t[way[0]] for t, way in zip(total, unit.ways))
        lo, last, here = 0, len(unit.keys), None
        while lo < last:
            hi = int(np.searchsorted(by_key, by_key[lo] + spread.PATHS, "right")) - 1
            hi = min(max(lo + 1, hi), lo + max(1, spread.CELLS // width), last)
            first, lo = lo, hi
            if by_key[hi] == by_key[first]:
                continue
            paths = []
            for (starts, _, _, _, near, root), (_, b, _, far), (at, n), t in zip(unit.ways, self.ways, found, total):
                i, j = starts[first], starts[hi]
                m, each = n[i:j], np.diff(t[starts[first : hi + 1]])
                edge = np.repeat(at[i:j] - t[i:j], m) + np.arange(t[i], t[j])
                adds = np.repeat(root[i:j], m)
                adds *= far[edge]
                adds += np.repeat(near[i:j], m)
                paths.append((m, edge, np.repeat(np.arange(hi - first) * width, each) + b[edge], adds, np.repeat(need[first:hi], each)))
            sums = np.bincount(np.concatenate([p[2] for p in paths]), np.concatenate([p[3] for p in paths]), (hi - first) * width)
            some = [np.flatnonzero(sums[cell] >= limit) for _, _, cell, _, limit in paths]
            if not any(map(len, some)):
                continue
            cells, of = np.unique(np.concatenate([p[2][s] for p, s in zip(paths, some)]), return_inverse=True)
            terms, of = [], (of[: len(some[0])], of[len(some[0]) :])
            for way, (_, _, e, _), (m, edge, *_), s, cell in zip(unit.ways, self.ways, paths, some, of):
                x, edge = way[0][first] + np.searchsorted(np.cumsum(m), s, "right"), edge[s]
                terms += [np.bincount(cell, way[4][x], len(cells)), np.bincount(cell, np.sqrt(way[3][x] * e[edge]), len(cells))]
            r, c = cells // width + first, cells % width
            if here is None:
                here = np.flatnonzero(unit.ways[1][1] // width * width == self.low)
                held = np.repeat(np.arange(last), np.diff(unit.ways[1][0]))[here] * width + unit.ways[1][1][here] - self.low
            link = np.zeros(len(cells))
            if len(here):
                at = np.minimum(np.searchsorted(held, r * width + c), len(here) - 1)
                link = np.where(held[at] == r * width + c, score[here[at]], 0.0)
            inner = (terms[0] + terms[1] + terms[2] + terms[3]) / 2
            outer = sum(np.maximum(0.0, m - t) for m, t in zip((unit.mass[0][r], self.holders[c], unit.mass[1][r], self.reached[c]), terms))
            both = inner + outer
            j000 = np.divide(inner, both, out=np.zeros(len(cells)), where=both != 0)
            nodes, known_by = np.sqrt(unit.weight[r] * self.weight[c]), (link + 1) / 2
            j110 = j000 * nodes * known_by
            k = np.flatnonzero(j110 >= least)
            if len(k):
                yield unit.keys[r[k]], c[k] + self.low, j000[k], (j000 * nodes)[k], (j000 * known_by)[k], j110[k]


def jaccard_of_groups(left_weights: DataFrame, right_weights: DataFrame, left_left: DataFrame, left_right: DataFrame, groups: DataFrame, least: float = 0.01) -> DataFrame:
    """jaccard() over the edges that groups(own) of right nodes make, n / (n + 1) for n groups."""
    edges = stash(counted(groups), "edges")
    own = (stash(x, "edges") for x in (left_weights, right_weights, left_left, left_right))
    return jaccard(*own, edges.union(edges.select("dst", "src", "score")), least)


def jaccard_in_blocks(left_weights: DataFrame, right_weights: DataFrame, left_left: DataFrame, left_right: DataFrame, groups: DataFrame, least: float = 0.01) -> DataFrame:
    """The ends and scores of jaccard_of_groups(), without rows of paths.

    A task takes some blocks of left nodes and some tiles of right nodes, and reads both from where they were stashed, so
    that neither is sent to all parts of the other.  Nodes are whole numbers; a link without one of its ends has no
    weight and goes, but where least is not over 0.  No pair stands twice in left_right.
    """
    if least <= 0:  # all candidates are wanted, those without a weight too
        return jaccard_of_groups(left_weights, right_weights, left_left, left_right, groups, least)
    width = WIDTH
    number = lambda df, **columns: df.select(*(F.col(c).cast(t).alias(n) for n, (c, t) in columns.items())).na.drop()
    lw = number(left_weights, id=("id", "long"), weight=("weight", "double"))
    by = lambda df, end: df.join(lw.withColumnRenamed("id", end), end, "left").fillna(0.0, ["weight"])
    links = by(number(left_right, a=("src", "long"), b=("dst", "long"), score=("score", "double")), "a").select("b", "a", "score", "weight")
    rw = number(right_weights, b=("id", "long"), weight=("weight", "double")).select("b", F.lit(0).cast("long").alias("a"), "weight")
    pairs = groups.mapInArrow(lambda batches: spread._dealt_pairs(batches, width), "tile long, data binary")
    rows = None
    for kind, df in enumerate((pairs, _dealt(links, width), _dealt(rw, width))):
        df = df.select("tile", F.lit(kind).alias("kind"), "data")
        rows = df if rows is None else rows.union(df)

    def build(t: pa.Table) -> pa.Table:
        parts = [[], [], []]
        for kind, data in zip(t["kind"].to_pylist(), t["data"]):
            parts[kind].append(spread.unpacked(data.as_py()))
        joined = lambda kind, c, none: np.concatenate([np.zeros(0, none), *(p[c] for p in parts[kind])])
        a, b, n = spread._added(*(joined(0, c, np.int64) for c in "abn"))
        weight = np.zeros(width)
        weight[joined(2, "b", np.int64) % width] = joined(2, "weight", float)
        loop = a == b + t["tile"][0].as_py() * width
        a, b, n = a[~loop], b[~loop], n[~loop]
        order = spread.in_order(a, b)
        a, b, n = a[order], b[order], n[order]
        order = spread.in_order(joined(1, "a", np.int64), joined(1, "b", np.int64))
        lb, la, score, w = (joined(1, c, none)[order] for c, none in (("b", np.int64), ("a", np.int64), ("score", float), ("weight", float)))
        blobs = [_by_end(a, b=b, n=n), _by_end(la, b=lb % width, score=score, weight=w), spread.packed(weight=weight)]
        lists = [pa.array([np.unique(x // d).tolist()], pa.list_(pa.int64())) for x, d in ((a, width), (la, RANGE))]
        return pa.table([t["tile"].slice(0, 1), *lists, *(pa.array([x], pa.binary()) for x in blobs)], names=["tile", "reached", "lefts", "data", "held", "weight"])

    spark = left_left.sparkSession
    with spread._sparing(spark):
        tiles = stash(rows.groupBy("tile").applyInArrow(build, "tile long, reached array<long>, lefts array<long>, data binary, held binary, weight binary"), "jaccard-tiles")

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the other ends of the edges of a tile what its nodes weigh for them."""
        for batch in batches:
            for tile, data, weight in zip(*batch.columns):
                x, weight = _ends(data.as_py()), spread.unpacked(weight.as_py())["weight"]
                at = spread.opens(x["a"])
                ends, m = x["a"][at], np.add.reduceat(np.sqrt(weight[x["b"]] * (x["n"] / (x["n"] + 1.0))), at) if len(at) else np.zeros(0)
                first = spread.opens(ends // width)
                data = [spread.packed(a=ends[i:j], m=m[i:j]) for i, j in zip(first, [*first[1:], len(ends)])]
                yield pa.record_batch([pa.array(ends[first] // width), pa.array([tile.as_py()] * len(first), pa.int64()), pa.array(data, pa.binary())], names=["tile", "by", "data"])

    def added(t: pa.Table) -> pa.Table:
        parts = [spread.unpacked(x.as_py()) for x in t.sort_by("by")["data"]]
        ends, at = np.unique(np.concatenate([p["a"] for p in parts]), return_inverse=True)
        m = np.bincount(at, np.concatenate([p["m"] for p in parts]), len(ends))
        return pa.table([t["tile"].slice(0, 1), pa.array([spread.packed(a=ends, m=m)], pa.binary())], names=["tile", "mass"])

    mass = tiles.select("tile", "data", "weight").mapInArrow(masses, "tile long, by long, data binary").groupBy("tile").applyInArrow(added, "tile long, mass binary")
    unit = spread.UNIT

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of a tile by units of left nodes, with the weights of right ones."""
        for batch in batches:
            for tile, data, weight in zip(*batch.columns):
                x, weight = _ends(data.as_py()), spread.unpacked(weight.as_py())["weight"]
                k, b, score = x["a"], x["b"].astype(np.int64), x["score"]
                first = spread.opens(k // unit)
                cuts = [slice(i, j) for i, j in zip(first, [*first[1:], len(k)])]
                data = [spread.packed(k=k[c], concept=b[c] + tile.as_py() * width, score=score[c], weight=weight[b[c]]) for c in cuts]
                ids = [pa.array([np.unique(k[c]).tolist() for c in cuts], pa.list_(pa.int64())), pa.array([[tile.as_py()]] * len(cuts), pa.list_(pa.int64()))]
                yield pa.record_batch([pa.array(k[first] // unit), *ids, pa.array(data, pa.binary())], names=["unit", "ks", "ats", "data"])

    own = tiles.select("tile", "held", "weight").mapInArrow(held, "unit long, ks array<long>, ats array<long>, data binary")
    left = by(number(left_left, k=("src", "long"), concept=("dst", "long"), score=("score", "double")), "concept").select("k", "concept", "score", "weight")
    kinds = ((spread.OWN, own), (LEFT, spread.units(left, RANGE)), (WEIGHTS, spread.units(lw.select(F.col("id").alias("k"), F.lit(0).cast("long").alias("concept"), "weight"))))
    mine = None
    for kind, df in kinds:
        df = df.select("unit", "ks", "ats", "data", F.lit(kind).cast("long").alias("kind"))
        mine = df if mine is None else mine.union(df)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each unit in one row."""
        at, parts, ats = None, {}, {}

        def one() -> pa.RecordBatch:
            lists = [pa.array([sorted(ats[kind])], pa.list_(pa.int64())) for kind in (LEFT, spread.OWN)]
            return pa.record_batch([pa.array([at]), *lists, *(pa.array([x], pa.binary()) for x in Unit.packed(parts))], names=["unit", "to_lefts", "ats", "own", "left", "right"])

        for batch in batches:
            for u, kind, near, data in zip(*(batch.column(c) for c in ("unit", "kind", "ats", "data"))):
                if u.as_py() != at:
                    if parts:
                        yield one()
                    at, parts, ats = u.as_py(), {spread.OWN: [], LEFT: [], WEIGHTS: []}, {spread.OWN: set(), LEFT: set(), WEIGHTS: set()}
                parts[kind.as_py()].append(spread.unpacked(data.as_py()))
                ats[kind.as_py()].update(near.as_py())
        if parts:
            yield one()

    side = math.ceil(math.sqrt(spark.sparkContext.defaultParallelism))
    with spread._sparing(spark):
        blocks, n = spread.in_blocks(stash(mine, "jaccard-own"), side)
        blocks = blocks.repartition(n, "block").sortWithinPartitions("unit").select("unit", "kind", "ats", "data")
        units = stash(blocks.mapInArrow(whole, "unit long, to_lefts array<long>, ats array<long>, own binary, left binary, right binary"), "jaccard-units")
        mass = stash(mass, "jaccard-mass")
        tiles = tiles.join(mass, "tile", "left").select("tile", "reached", "lefts", "data", "held", "weight", "mass")
        tiles = stash(tiles, "jaccard-massed")
    theirs, ours = tiles.columns, units.columns
    lead = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) == 0
    met = tiles.coalesce(3 * side).select("*", lead.alias("leads")).hint("shuffle_replicate_nl").crossJoin(units.coalesce(max(side, -(-n // 16))).select("*", lead.alias("heads")))
    # a task gets its units with its first tile, and its tiles with its first unit
    sent = met.where("leads or heads").select(*(F.when(F.col("leads"), F.col(c)).alias(c) for c in ours), *(F.when(F.col("heads"), F.col(c)).alias(c) for c in theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waits = [], None

        def meet(tile: int, reached: list[int], lefts: list[int], *data: bytes | None) -> Iterator[pa.RecordBatch]:
            laid = None
            for to_lefts, ats, *unit in own:
                if not ats.isdisjoint(reached) or not to_lefts.isdisjoint(lefts):
                    laid = laid or Tile(tile, width, *data)
                    found = list(laid.links(Unit(*unit), least))
                    if found:
                        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], names=["src", "dst", "jaccard_000", "jaccard_100", "jaccard_010", "jaccard_110"])

        for batch in batches:
            for row in zip(*batch.columns):
                unit, tile = row[: len(ours)], row[len(ours) :]
                if tile[0].is_valid:
                    if waits:  # for units, which come with the first tile
                        yield from meet(*waits)
                    waits = [c.as_py() for c in tile]
                if unit[0].is_valid:
                    _, to_lefts, ats, *data = (c.as_py() for c in unit)
                    own.append((set(to_lefts), set(ats), *data))
        if waits:
            yield from meet(*waits)

    schema = "src long, dst long, jaccard_000 double, jaccard_100 double, jaccard_010 double, jaccard_110 double"
    with spread._sparing(spark):
        out = stash(sent.mapInArrow(run, schema), "jaccard-links")
    return out.withColumn("src", F.col("src").cast(left_right.schema["src"].dataType)).withColumn("dst", F.col("dst").cast(left_right.schema["dst"].dataType))
