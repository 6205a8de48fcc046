"""Graphs as edge tables (src, dst, score): symmetry, balls, distances, components, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stash


def reversed_(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; scores add up where both were there."""
    return edges.unionByName(reversed_(edges)).groupBy("src", "dst").agg(F.sum("score").alias("score"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def normalised(edges: DataFrame) -> DataFrame:
    """Both directions with their mean score, no loops but one of score 1 on every vertex."""
    edges = edges.where("src <> dst").select("src", "dst", "score")
    mean = edges.unionByName(reversed_(edges)).groupBy("src", "dst").agg(F.avg("score").alias("score"))
    return mean.unionByName(vertices(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("score")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, strength: edges at either end, and their scores."""
    ends = edges.select(F.col("src").alias("id"), "score").union(edges.select("dst", "score"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("score").alias("strength"))


def sources_and_sinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, kind of the nodes without an edge in, out or either: one pass over the ends."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("dst", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    seen = nodes.select("id").join(ends, "id", "left").fillna(0)
    kind = F.when((F.col("out") == 0) & (F.col("in") == 0), "isolated").when(F.col("in") == 0, "source").when(F.col("out") == 0, "sink")
    return seen.select("id", kind.alias("kind")).where("kind is not null")


def ball(edges: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """id, distance of all nodes within `radius` steps of start(id): a frontier join for each step."""
    reached = start.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = reached
    for step in range(1, radius + 1):
        ahead = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = ahead.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(step))
        if step < radius:
            frontier = stash(frontier, "frontier")
        reached = reached.union(frontier)
    return reached


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest node that each node reaches.

    Each round hooks a node to its smallest neighbour and follows the hooks twice; edges are contracted until none is
    left.  Edges between two nodes count once, so a hub costs a row for each neighbour.  Labels stay in tables throughout;
    lone nodes are absent.
    """
    labels = None
    edges = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    while True:
        edges = stash(edges, "edges")
        if labels is not None and edges.isEmpty():
            return labels
        sides = edges.union(edges.select("dst", "src"))
        hook = stash(sides.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("up")), "hooks")
        follow = hook.select(F.col("id").alias("up"), F.col("up").alias("next"))
        hook = hook.join(follow, "up").select("id", F.col("next").alias("up"))
        hook = stash(hook.join(follow, "up").select("id", F.col("next").alias("up")), "hooks")
        if labels is None:
            labels = hook.select("id", F.col("up").alias("component"))
        else:
            labels = labels.join(hook.select(F.col("id").alias("component"), "up"), "component", "left")
            labels = stash(labels.select("id", F.coalesce("up", "component").alias("component")), "labels")
        ends = [hook.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("src", "dst")]
        edges = edges.join(ends[0], "src").join(ends[1], "dst").where("src_up <> dst_up")
        edges = edges.select(F.least("src_up", "dst_up").alias("src"), F.greatest("src_up", "dst_up").alias("dst")).distinct()


def distances(edges: DataFrame, start: DataFrame, limit: int = 6) -> DataFrame:
    """start, id, distance from every start(id) to all nodes within `limit` steps."""
    reached = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    frontier = reached
    for step in range(1, limit + 1):
        ahead = frontier.select("start", F.col("id").alias("src")).join(edges.select("src", "dst"), "src")
        ahead = ahead.select("start", F.col("dst").alias("id")).distinct().join(reached.select("start", "id"), ["start", "id"], "left_anti")
        frontier = stash(ahead.withColumn("distance", F.lit(step)), "frontier")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def ancestors(tree: DataFrame, depth: int = 8) -> DataFrame:
    """node, ancestor, steps (0 for itself) in a table (child, parent) of at most `depth` levels."""
    nodes = tree.select(F.col("child").alias("node")).union(tree.select("parent")).distinct()
    level = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    out = level
    for step in range(1, depth + 1):
        level = level.join(tree, level.ancestor == tree.child).select("node", F.col("parent").alias("ancestor"), F.lit(step).alias("steps"))
        out = out.union(level)
    return out


def paths(tree: DataFrame, depth: int = 8) -> DataFrame:
    """node, path from the root, level."""
    chain = ancestors(tree, depth).groupBy("node").agg(F.sort_array(F.collect_list(F.struct(-F.col("steps"), "ancestor"))).alias("chain"))
    return chain.select("node", F.array_join(F.transform("chain", lambda x: x["ancestor"]), "/").alias("path"), (F.size("chain") - 1).alias("level"))


def graph_score(results: DataFrame, edges: DataFrame, smoothing: bool = True) -> DataFrame:
    """results with graph_score: the strength of each concept in the graph that the results induce, over the greatest.

    Concepts without an edge inside go; without any edge at all every score is 1.
    """
    from ..functions.expr import concave
    from .relational import induced, of_greatest

    ids = results.select(F.col("concept_id").alias("id")).distinct()
    inside = induced(edges, ids).groupBy(F.col("src").alias("concept_id")).agg(F.sum("score").alias("graph_score"))
    inside = of_greatest(inside, "graph_score")
    if smoothing:
        inside = inside.withColumn("graph_score", concave(F.col("graph_score")))
    empty = inside.agg((F.count("*") == 0).alias("none"))
    scored = results.join(inside, "concept_id", "left").crossJoin(F.broadcast(empty))
    scored = scored.withColumn("graph_score", F.when(F.col("none"), 1.0).otherwise(F.col("graph_score")))
    return scored.where("graph_score is not null").drop("none")
