"""Embedding near-duplicates by NN-descent.

Equal vectors count once, with their number.  Tight balls come next: vectors
that share a code of random hyperplanes with a pivot and lie within half the
linking angle of it.  By the triangle inequality all members of a ball link
with each other, so a large group of near copies counts as one node.  The
neighbour graph of the pivots starts from neighbours along random projections
and codes, and is refined in rounds: every node introduces its neighbours,
forward and reverse, to each other, and each keeps its best `k`.  Edges between
balls that may hold links join them into groups.  A list that holds nothing but
such edges is saturated: its node takes part in a further pass, with a longer
list and for neighbours outside of its group only, until no list is full.  So
the graph grows with the nodes and never with the pairs of a dense group.  A
brute-force audit of a sample, another one in every pass and before its finds
are added, measures the recall of pairs in reach; while it is short, passes go
on with more codes, and the operator fails if no pass is good enough.  In the
end the nodes of each group are compared in blocks, in double precision: pairs
of balls are counted in whole where the bounds decide, and by their members
where they do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components, spanning_forest
from ._shared import n_partitions, stash, table, unstash

#: Hyperplanes to a code, codes tried, neighbours kept in the first pass, rounds at most, nodes audited, recall wanted.
BITS, CODES, K, ROUNDS, AUDITED, RECALL = 20, 4, 12, 12, 512, 0.995
#: Projections for the first graph, followers along each.
PROJECTIONS, FOLLOWERS = 4, 4
#: Passes at most; codes that introduce nodes in the first (twice as many in each later one), nodes to a code, about.
PASSES, MEETINGS, MET = 6, 8, 64
#: Members of a list that meet; those compared with them at once; members of a ball to a row; nodes of a group to a block.
MOST_MET, INTRODUCED, MEMBERS, BLOCK = 4096, 256, 512, 2048


def _planes(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def usable(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, grp, unit: the vectors that can link at all, scaled to length one in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    scaled = F.transform("v", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("v", v).withColumn("top", top).where("top > 0")
    rows = rows.withColumn("scaled", scaled).withColumn("norm", norm)
    group = F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))
    return rows.select("rid", "vec_id", group.alias("grp"), F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _codes(units: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((len(batch), BITS * CODES), bool)
            for dim, at, x in _by_dim(batch.column(2)):
                bits[at] = x @ _planes(1, dim, BITS * CODES) > 0
            weights = 1 << np.arange(BITS)
            codes = [pa.array(bits[:, k * BITS : (k + 1) * BITS] @ weights) for k in range(CODES)]
            yield pa.record_batch([batch.column(0), batch.column(1), *codes], names=["rid", "grp", *(f"c{k}" for k in range(CODES))])

    return units.select("rid", "grp", "unit").mapInArrow(run, "rid long, grp string, " + ", ".join(f"c{k} long" for k in range(CODES)))


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) of a column of vectors."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def balls(units: DataFrame, half_angle: float) -> DataFrame:
    """rid, pid, angle: the pivot of each vector and the angle to it; a lone vector is its own pivot.

    In each round the least free vector of a code, or a pivot that has members already, takes what is near; pivots with
    members are never taken themselves.
    """
    codes = stash(_codes(units), "codes")
    vec = units.select("rid", "unit")
    taken = None
    for k in range(CODES):
        free = codes if taken is None else codes.join(taken.select("rid"), "rid", "left_anti")
        pivots = None if taken is None else taken.select(F.col("pid").alias("rid")).distinct().withColumn("old", F.lit(0))
        free = free.withColumn("old", F.lit(1)) if pivots is None else free.join(pivots, "rid", "left").withColumn("old", F.coalesce("old", F.lit(1)))
        lead = free.groupBy("grp", f"c{k}").agg(F.min(F.struct("old", "rid"))["rid"].alias("pid"), F.count("*").alias("n")).where("n > 1")
        pairs = free.where("old = 1").join(lead, ["grp", f"c{k}"]).where("rid != pid").select("rid", "pid")
        pairs = pairs.join(vec, "rid").join(vec.select(F.col("rid").alias("pid"), F.col("unit").alias("other")), "pid")
        near = pairs.select("rid", "pid", F.acos(F.least(_dot("unit", "other"), F.lit(1.0))).alias("angle")).where(F.col("angle") <= half_angle)
        taken = stash(near if taken is None else taken.union(near), f"balls{k}")
    lone = units.select("rid").join(taken.select("rid"), "rid", "left_anti")
    return stash(taken.union(lone.select("rid", F.col("rid").alias("pid"), F.lit(0.0).alias("angle"))), "balls")


def _chained(nodes: DataFrame, seed: int) -> DataFrame:
    """id, nbr, sim: each node with those that follow it along a random projection, both ways."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = np.zeros(len(batch))
            x = batch.column(2).to_pylist()
            for dim in {len(b) for b in x}:
                at = [i for i, b in enumerate(x) if len(b) == dim]
                along[at] = np.stack([np.frombuffer(x[i], np.float32) for i in at]) @ _planes(seed, dim // 4, 1)[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(along)], names=["id", "grp", "v", "along"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []
        for batch in batches:
            a, b, s = [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "grp", "v"))):
                tail = [t for t in tail if t[1] == row[1]][-FOLLOWERS:]
                x = np.frombuffer(row[2], np.float32)
                for i, _, v in tail:
                    sim = float(np.frombuffer(v, np.float32) @ x)
                    a += [i, row[0]]
                    b += [row[0], i]
                    s += [sim, sim]
                tail.append(row)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["id", "nbr", "sim"])

    placed = nodes.select("id", "grp", "v").mapInArrow(project, "id long, grp string, v binary, along double")
    placed = placed.repartitionByRange(n_partitions(nodes.sparkSession), "grp", "along").sortWithinPartitions("grp", "along")
    return placed.mapInArrow(link, "id long, nbr long, sim double")


def _introduce(k: int):
    """For rows in order of c: pairs of members of one list, of two groups, that are closer than what the first of them has.

    Lists meet in parts of MOST_MET members; each member gets the k best.
    """

    def closer(rows: list[tuple]):
        if len(rows) < 2 or not any(r[4] for r in rows):
            return
        ids, kth, fresh, group = (np.array([r[c] for r in rows]) for c in (1, 3, 4, 5))
        x = np.stack([np.frombuffer(r[2], np.float32) for r in rows])
        for at in range(0, len(rows), INTRODUCED):
            own = slice(at, at + INTRODUCED)
            sim = (x[own] @ x.T).astype(float)
            better = (sim > kth[own, None]) & (fresh[own, None] | fresh) & (group[own, None] != group)
            if len(rows) > k:
                best = np.where(better, sim, -np.inf)
                better &= best >= np.partition(best, -k, axis=1)[:, -k, None]
            i, j = np.nonzero(better)
            if len(i):
                yield pa.record_batch([pa.array(ids[own][i]), pa.array(ids[j]), pa.array(sim[i, j])], names=["id", "nbr", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) == MOST_MET):
                    yield from closer(held)
                    held = []
                held.append(row)
        yield from closer(held)

    return run


def _met(nodes: DataFrame, seed: int, n_codes: int, k: int, n: int) -> DataFrame:
    """id, nbr, sim: nodes that share one of n_codes codes of random hyperplanes, each with its nearest among them."""
    bits = max(1, int(np.ceil(np.log2(max(n, 1) / MET))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).to_pylist()
            code = np.zeros((len(v), n_codes), np.int64)
            for size in {len(b) for b in v}:
                at = [i for i, b in enumerate(v) if len(b) == size]
                x = np.stack([np.frombuffer(v[i], np.float32) for i in at]) @ _planes(seed, size // 4, n_codes * bits)
                code[at] = (x > 0).reshape(len(at), n_codes, bits) @ (1 << np.arange(bits))
            yield pa.record_batch([*batch.columns, pa.array(list(code), pa.list_(pa.int64()))], names=["id", "grp", "v", "group", "codes"])

    coded = nodes.select("id", "grp", "v", "group").mapInArrow(run, "id long, grp string, v binary, group long, codes array<long>")
    coded = coded.select("id", "grp", "v", "group", F.posexplode("codes").alias("t", "code"))
    rows = coded.select(F.xxhash64("grp", "t", "code").alias("c"), F.col("id").alias("m"), "v", F.lit(-2.0).alias("kth"), F.lit(True).alias("fresh"), "group")
    return rows.repartition("c").sortWithinPartitions("c", F.xxhash64("m", F.lit(seed))).mapInArrow(_introduce(k), "id long, nbr long, sim double")


def neighbour_graph(nodes: DataFrame, k: int = K, rounds: int = ROUNDS, turn: int = 0) -> DataFrame:
    """id, nbr, sim: for each node of nodes(id, grp, v, group) its k nearest found outside of its group.

    Every turn has projections and codes of its own.
    """
    n = nodes.count()
    group = nodes.select("id", "group")
    graph = _met(nodes, 200 + turn, MEETINGS << turn, k, n)
    for p in range(PROJECTIONS):
        chained = _chained(nodes, 100 + p + PROJECTIONS * turn).join(group, "id").join(group.select(F.col("id").alias("nbr"), F.col("group").alias("other")), "nbr")
        graph = graph.union(chained.where("group <> other").select("id", "nbr", "sim"))
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    graph = stash(kept(graph.withColumn("fresh", F.lit(True))), "graph")
    for r in range(rounds):
        kth = graph.groupBy("id").agg(F.min("sim").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("id", "kth")
        member = nodes.join(kth, "id", "left").select(F.col("id").alias("m"), "v", F.coalesce("kth", F.lit(-2.0)).alias("kth"), "group")
        ends = graph.select(F.col("id").alias("c"), F.col("nbr").alias("m"), "fresh")
        ends = ends.union(graph.select(F.col("nbr").alias("c"), F.col("id").alias("m"), "fresh"))
        lists = ends.groupBy("c", "m").agg(F.max("fresh").alias("fresh"))
        lists = lists.union(nodes.select(F.col("id").alias("c"), F.col("id").alias("m"), F.lit(False).alias("fresh")))
        lists = lists.join(member, "m").select("c", "m", "v", "kth", "fresh", "group")
        met = lists.repartition("c").sortWithinPartitions("c", F.xxhash64("m", F.lit(r))).mapInArrow(_introduce(k), "id long, nbr long, sim double")
        old, last = graph.select("id", "nbr", "sim").withColumn("fresh", F.lit(False)), graph
        graph = stash(kept(old.union(met.withColumn("fresh", F.lit(True)))), f"graph{r}")
        unstash(last)
        if graph.where("fresh").count() <= 0.002 * n * k:
            break
    return graph


def _reach(a, b, theta: float):
    """The least cosine at which two balls of radius a and b may hold a link, less what single precision may lose."""
    return F.cos(F.least(a + b + F.lit(theta), F.lit(float(np.pi)))) - 1e-5


def audit(nodes: DataFrame, theta: float, turn: int = 0) -> tuple[float, DataFrame]:
    """(recall, missed): the share of the pairs in reach of a sample of nodes(id, grp, v, radius, group) that are in one
    group; the others, as id, nbr.

    Every turn has a sample of its own.
    """
    asked = nodes.orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(AUDITED).select("id", "grp", "v", "radius", "group").toArrow()
    ids, radius, group = (asked[c].to_numpy() for c in ("id", "radius", "group"))
    groups, vectors = np.array(asked["grp"].to_pylist(), object), asked["v"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, r, joined = (batch.column(c).to_numpy() for c in (0, 3, 4))
            grp, seen = np.array(batch.column(1).to_pylist(), object), 0
            found = []
            for g in set(grp) & set(groups):
                a, b = np.flatnonzero(groups == g), np.flatnonzero(grp == g)
                x = np.stack([np.frombuffer(vectors[i], np.float32) for i in a])
                y = np.stack([np.frombuffer(batch.column(2)[int(i)].as_py(), np.float32) for i in b])
                near = np.cos(np.minimum(radius[a][:, None] + r[b] + theta, np.pi)) - 1e-5
                hit = ((x @ y.T).astype(float) >= near) & (ids[a][:, None] != own[b])
                seen += int(hit.sum())
                i, j = np.nonzero(hit & (group[a][:, None] != joined[b]))
                found.append((ids[a[i]], own[b[j]]))
            id_, nbr = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            n = np.append(np.ones(len(id_), np.int64), seen)
            yield pa.record_batch([pa.array([*id_.tolist(), None], pa.int64()), pa.array([*nbr.tolist(), None], pa.int64()), pa.array(n)], names=["id", "nbr", "n"])

    truth = stash(nodes.select("id", "grp", "v", "radius", "group").mapInArrow(run, "id long, nbr long, n long"), "audit")
    n = truth.where("id is null").agg(F.sum("n")).first()[0] or 0
    missed = truth.where("id is not null").select("id", "nbr")
    return (1 - missed.count() / n if n else 1.0), missed


def grouped(nodes: DataFrame, theta: float) -> DataFrame:
    """nodes(id, grp, v, radius) with group: two nodes of one group if their balls may hold a link with each other.

    Fails if the audits of all passes find too many such pairs apart.
    """
    radii = nodes.select("id", "radius")
    alone = nodes.withColumn("group", F.col("id"))
    of, active, edges, k, recall, left = alone, alone, None, K, 0.0, 0
    for turn in range(PASSES):
        graph = neighbour_graph(active, k, turn=turn)
        ends = graph.join(radii, "id").join(radii.select(F.col("id").alias("nbr"), F.col("radius").alias("other")), "nbr")
        near = stash(ends.where(F.col("sim") >= _reach(F.col("radius"), F.col("other"), theta)).select("id", "nbr"), "near")
        unstash(graph)
        edges = near if edges is None else edges.union(near)
        of = stash(_joined(nodes, edges), "groups")
        recall, missed = audit(of, theta, turn)
        edges = edges.union(missed)  # after they were measured
        full = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
        active, left = of.join(full, "id", "left_semi"), full.count()
        if recall >= RECALL and not left:
            return stash(_joined(nodes, edges), "groups")
        if recall < RECALL:
            active = of
        k *= 2
    raise RuntimeError(f"after {PASSES} passes {recall:.4f} of the pairs in reach are in one group, not {RECALL}, and {left} lists are full")


def _joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    root = components(edges.toDF("a", "b")).select(F.col("node").alias("id"), "root")
    return nodes.join(root, "id", "left").select("id", "grp", "v", "radius", F.coalesce("root", "id").alias("group"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for every row of vectors(vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, is at least `threshold`.  Null, zero
    or empty vectors, such with null or other than finite components, and rows without label link with nothing, as do
    vectors of different lengths.  n_links counts other rows, so repeated rows link with each other.  component_id is
    the smallest vec_id reachable; a row without vec_id takes part, and is kept only if its whole component has none.
    """
    rows = stash(vectors.select("vec_id", "embedding", "label").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    every = stash(usable(rows), "units")
    units = stash(every.groupBy("grp", "unit").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "distinct")
    alike = stash(every.join(units.select("grp", "unit", F.col("rid").alias("did")), ["grp", "unit"]).select("rid", "did"), "copies")
    theta = float(np.arccos(threshold))
    ball = balls(units, theta / 2 - 1e-7)
    ball = stash(ball.join(units.select("rid", "copies"), "rid"), "weighted")
    sizes = ball.groupBy("pid").agg(F.sum("copies").alias("size"), F.count("*").alias("members"), F.max("angle").alias("radius"))
    sizes = stash(sizes, "sizes")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, np.float32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(v, pa.binary()), batch.column(3)], names=["id", "grp", "v", "radius"])

    nodes = units.join(sizes, F.col("rid") == F.col("pid")).select(F.col("rid").alias("id"), "grp", "unit", "radius")
    nodes = stash(nodes.mapInArrow(single, "id long, grp string, v binary, radius double"), "nodes")
    return _linked(rows, alike, units, ball, sizes, grouped(nodes, theta).select("id", "grp", "group"), threshold, theta)


def _blocks_compared(threshold: float, theta: float):
    """For pairs of blocks of nodes: links of each node, a spanning forest of them, and the pairs that bounds leave open."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, x, radius, size = zip(*(_of_block(batch, row, side) for side in ("1", "2")))
                within = batch.column("part1")[row] == batch.column("part2")[row]
                n = [np.zeros(len(i), np.int64) for i in ids]
                links, apart, open_ = [], len(ids[0]), []
                for k in range(0, len(ids[0]), MEMBERS):
                    own = slice(k, k + MEMBERS)
                    sim = x[0][own] @ x[1].T
                    slack = radius[0][own, None] + radius[1]
                    hit = sim >= threshold
                    doubt = np.zeros_like(hit)
                    if slack.any():
                        angle = np.arccos(np.clip(sim, -1, 1))
                        wide = slack > 0
                        hit = np.where(wide, angle + slack <= theta - 1e-7, hit)
                        doubt = wide & ~hit & (angle - slack <= theta + 1e-7)
                    if within:
                        i = np.arange(len(sim))
                        hit[i, k + i] = doubt[i, k + i] = False
                        doubt &= np.arange(hit.shape[1]) > (k + i)[:, None]
                    n[0][own] += hit @ size[1]
                    if not within:
                        n[1] += size[0][own] @ hit
                    i, j = np.nonzero(hit)
                    links.append(spanning_forest(k + i, j if within else apart + j, apart + len(ids[1])))
                    i, j = np.nonzero(doubt)
                    open_.append((ids[0][k + i], ids[1][j]))
                node, root = spanning_forest(*map(np.concatenate, zip(*links)), apart + len(ids[1]))
                both = np.concatenate([ids[0], ids[1]])
                p, q = map(np.concatenate, zip(*open_))
                for kind, a, b in (("n", both, np.concatenate(n)), ("link", both[node], both[root]), ("open", p, q)):
                    some = np.flatnonzero(b) if kind == "n" else np.arange(len(a))
                    if len(some):
                        yield pa.record_batch([pa.array([kind] * len(some)), pa.array(a[some]), pa.array(b[some])], names=["kind", "a", "b"])

    return compare


def _of_block(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, ...]:
    ids, x, radius, size = (batch.column(f"{c}{side}")[row].values.to_numpy() for c in ("ids", "x", "radii", "sizes"))
    return ids, x.reshape(len(ids), -1), radius, size


def _linked(
    rows: DataFrame, alike: DataFrame, units: DataFrame, ball: DataFrame, sizes: DataFrame, groups: DataFrame, threshold: float, theta: float
) -> DataFrame:
    """The links between members of the balls of each group, and within balls, counted and followed."""
    several = groups.groupBy("group", "grp").agg(F.count("*").alias("nodes")).where("nodes > 1")
    node = groups.join(several, ["group", "grp"]).join(units.select(F.col("rid").alias("id"), "unit"), "id").join(sizes, F.col("id") == F.col("pid"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("nodes") / BLOCK)).alias("part")
    block = node.groupBy("group", "grp", part).agg(F.collect_list(F.struct("id", "radius", "size", "unit")).alias("b"))
    block = block.select(
        "group", "grp", "part", F.col("b.id").alias("ids"), F.flatten("b.unit").alias("x"), F.col("b.radius").alias("radii"), F.col("b.size").alias("sizes")
    )
    block = stash(block, "blocks")
    one, two = (block.select("group", "grp", *(F.col(c).alias(f"{c}{k}") for c in block.columns[2:])) for k in (1, 2))
    pairs = one.join(two, ["group", "grp"]).where("part1 <= part2").drop("group", "grp")
    found = stash(pairs.repartition(n_partitions(rows.sparkSession), "part1", "part2").mapInArrow(_blocks_compared(threshold, theta), "kind string, a long, b long"), "found")

    whole = found.where("kind = 'n'").groupBy(F.col("a").alias("pid")).agg(F.sum("b").alias("n"))
    counts = ball.select("rid", "pid").join(whole, "pid").select("rid", "n")
    within = ball.join(sizes, "pid").where("size > 1").select("rid", (F.col("size") - 1).alias("n"))

    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("members") / MEMBERS)).alias("part")
    packed = ball.join(sizes, "pid").join(units.select("rid", "unit"), "rid").groupBy("pid", part)
    packed = stash(packed.agg(F.collect_list(F.struct("rid", "copies", "unit")).alias("b")), "members")
    packed = packed.select("pid", F.col("b.rid").alias("rids"), F.col("b.copies").alias("copies"), F.flatten("b.unit").alias("x"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                (a, m, x), (b, n, y) = ([batch.column(f"{c}{k}")[row].values.to_numpy() for c in ("rids", "copies", "x")] for k in (1, 2))
                hit = x.reshape(len(a), -1) @ y.reshape(len(b), -1).T >= threshold
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                node, root = spanning_forest(i, len(a) + j, len(a) + len(b))
                ids, total = np.concatenate([a, b]), np.concatenate([hit @ n, m @ hit])
                some = np.flatnonzero(total)
                yield pa.record_batch([pa.array(["n"] * len(some)), pa.array(ids[some]), pa.array(total[some])], names=["kind", "a", "b"])
                yield pa.record_batch([pa.array(["link"] * len(node)), pa.array(ids[node]), pa.array(ids[root])], names=["kind", "a", "b"])

    left, right = (packed.select(*(F.col(c).alias(f"{c}{k}") for c in packed.columns)) for k in (1, 2))
    close = found.where("kind = 'open'").join(left, F.col("a") == F.col("pid1")).join(right, F.col("b") == F.col("pid2"))
    member = stash(close.select("rids1", "copies1", "x1", "rids2", "copies2", "x2").mapInArrow(compare, "kind string, a long, b long"), "links")

    n_links = counts.union(within).union(member.where("kind = 'n'").select("a", "b")).groupBy(F.col("rid").alias("did")).agg(F.sum("n").alias("n_links"))
    links = ball.where("rid != pid").select(F.col("rid").alias("a"), F.col("pid").alias("b"))
    links = links.union(found.where("kind = 'link'").select("a", "b")).union(member.where("kind = 'link'").select("a", "b"))
    root = components(links).select(F.col("node").alias("did"), "root")
    of = rows.select("rid", "vec_id").join(alike, "rid", "left").join(n_links, "did", "left").join(root, "did", "left")
    of = of.withColumn("root", F.coalesce("root", "did", "rid"))
    least = of.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return of.join(least, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
