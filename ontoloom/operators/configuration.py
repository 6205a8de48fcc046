"""Configurations: scores of concepts under any key, with the columns concept and score and the key in all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import distance_affinity, safe_div
from .graph import normalised
from .relational import strong, unit
from .spread import measured, spread


def key_of(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c not in ("concept", "score")]


def mixed(x: DataFrame, graph: DataFrame, ratio: float = 0.05) -> DataFrame:
    """Scores spread over a normalised graph (src, dst, score): the mean, over the ball of a concept, of score times edge.

    Scores under `ratio` of the greatest of their key go.
    """
    key = key_of(x)
    size = F.count("*").over(Window.partitionBy("dst"))
    steps = graph.select(F.col("src").alias("concept"), "dst", F.col("score").alias("edge"), size.alias("size"))
    out = x.join(steps, "concept").groupBy(*key, F.col("dst").alias("concept"))
    out = out.agg(F.sum(F.col("score") * F.col("edge") / F.col("size")).alias("score"))
    return strong(out, "score", key, ratio) if ratio else out


def _whole(x: DataFrame) -> bool:
    return all(x.schema[c].dataType.simpleString() in ("int", "bigint") for c in [*key_of(x), "concept"])


def mixed_over(x: DataFrame, edges: DataFrame, ratio: float = 0.05) -> DataFrame:
    """mixed() over the normalised graph of edges(src, dst, score), or of groups(own); see spread.tiles().

    Each score is a sum in the order of concepts, so what is at the limit does not hang on how rows lie.
    """
    return spread(x, key_of(x)[0], edges, ratio)


def norms(x: DataFrame) -> DataFrame:
    return x.groupBy(*key_of(x)).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))


def counted(groups: DataFrame) -> DataFrame:
    """src < dst, score: n / (n + 1) for the n groups(own) that two share."""
    pairs = groups.select(F.explode("own").alias("src"), "own").select("src", F.explode("own").alias("dst")).where("src < dst")
    return pairs.groupBy("src", "dst").agg((F.count("*") / (F.count("*") + 1.0)).alias("score"))


def affinities(
    x: DataFrame, y: DataFrame, pairs: DataFrame, edges: DataFrame | None = None, mix_x: bool = False, mix_y: bool = False,
    normalise_before: bool = False, method: str = "cosine", k: float = 1.0,
) -> DataFrame:
    """pairs with score: how alike two configurations are.

    pairs has the key columns of x and of y, which have to differ in name.  The cosine of configurations without a
    common concept is 0; edges may be groups(own); "euclidean" maps their distance d to 1 - tanh(d / k).
    """
    kx, ky = key_of(x), key_of(y)
    if mix_x and not mix_y and not normalise_before and _whole(x) and len(kx) == len(ky) == 1:
        found = measured(x, kx[0], y, ky[0], edges)  # the spread scores are many: they stay in tasks
        dot = found.where("dot is not null").select(*kx, *ky, "dot")
        return _compared(pairs, dot, found.where("norm is not null").select(*kx, F.col("norm").alias("norm_x")), norms(y).withColumnRenamed("norm", "norm_y"), kx, ky, method, k)
    if edges is not None and edges.columns == ["own"]:
        edges = counted(edges)
    graph = normalised(edges) if edges is not None else None
    x = mixed(x, graph) if mix_x else x
    y = mixed(y, graph) if mix_y else y
    if normalise_before:
        x, y = (c.withColumn("score", unit("score", *key)) for c, key in ((x, kx), (y, ky)))
    nx, ny = norms(x).withColumnRenamed("norm", "norm_x"), norms(y).withColumnRenamed("norm", "norm_y")
    both = pairs.join(x.withColumnRenamed("score", "score_x"), kx).join(y.withColumnRenamed("score", "score_y"), [*ky, "concept"])
    dot = both.groupBy(*kx, *ky).agg(F.sum(F.col("score_x") * F.col("score_y")).alias("dot"))
    return _compared(pairs, dot, nx, ny, kx, ky, method, k)


def _compared(pairs: DataFrame, dot: DataFrame, nx: DataFrame, ny: DataFrame, kx: list[str], ky: list[str], method: str, k: float) -> DataFrame:
    out = pairs.join(dot, [*kx, *ky], "left").join(nx, kx, "left").join(ny, ky, "left").fillna(0, ["dot", "norm_x", "norm_y"])
    if method == "cosine":
        score = safe_div(F.col("dot"), F.col("norm_x") * F.col("norm_y"))
    elif method == "euclidean":  # |x - y|^2 = |x|^2 + |y|^2 - 2 x.y, so no outer join of the concepts is needed
        score = distance_affinity(F.sqrt(F.greatest(F.lit(0.0), F.expr("norm_x * norm_x + norm_y * norm_y - 2 * dot"))), k)
    else:
        raise ValueError(f"unknown method {method}")
    return out.select(*kx, *ky, score.alias("score"))
