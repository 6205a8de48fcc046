"""Vectors compared in blocks: products of matrices instead of rows for pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stash
from .relational import top_n

#: Vectors to a block, about.
BLOCK = 1024

Block = tuple[np.ndarray, np.ndarray]


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """group, part, ids, x: vectors(group, id, vector) in blocks of about `size`, however large a group is.

    Vectors of a group have one length; null ones, and those without id or group, are left out.
    """
    known = vectors.where("vector is not null and id is not null and `group` is not null").select("group", "id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    n = known.groupBy("group").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    packed = known.join(n, "group").groupBy("group", part).agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("b"))
    return packed.select("group", "part", F.col("b.id").alias("ids"), F.flatten("b.vector").alias("x"))


def compared(vectors: DataFrame, f: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str, size: int = BLOCK) -> DataFrame:
    """What f(block, block, same) gives for every two blocks of a group, each way round, and each with itself."""
    packed = stash(blocks(vectors, size), "blocks")
    one, two = (packed.select("group", *(F.col(c).alias(f"{c}{k}") for c in ("part", "ids", "x"))) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, x = ([batch.column(f"{c}{k}")[row].values.to_numpy() for k in (1, 2)] for c in ("ids", "x"))
                a, b = ((i, v.reshape(len(i), -1)) for i, v in zip(ids, x))
                yield from f(a, b, batch.column("part1")[row] == batch.column("part2")[row])

    pairs = one.join(two, "group")
    return pairs.repartition("group", "part1", "part2").mapInArrow(run, schema)


def nearest(vectors: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """src, dst, score: for every vector of vectors(group, id, vector) the k others of its group with the greatest product.

    Of products that agree in so many decimals the one with the least id comes first.
    """

    def f(a: Block, b: Block, same: bool) -> Iterator[pa.RecordBatch]:
        score = a[1] @ b[1].T
        ranked = np.round(score, decimals)
        if same:
            np.fill_diagonal(ranked, -np.inf)
        best = np.argsort(-ranked, axis=1, kind="stable")[:, :k]  # ids are in order, so ties go to the least
        row = np.repeat(np.arange(len(best)), best.shape[1])
        col = best.ravel()
        some = ranked[row, col] > -np.inf
        row, col = row[some], col[some]
        yield pa.record_batch([pa.array(a[0][row]), pa.array(b[0][col]), pa.array(score[row, col])], names=["src", "dst", "score"])

    found = compared(vectors, f, "src long, dst long, score double")
    return top_n(found, k, ["src"], F.desc(F.round("score", decimals)), F.col("dst"))


def sums(vectors: DataFrame, curve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id, total: the sum of a curve over the products with all other vectors of the group."""

    def f(a: Block, b: Block, same: bool) -> Iterator[pa.RecordBatch]:
        value = curve(a[1] @ b[1].T)
        if same:
            np.fill_diagonal(value, 0)
        yield pa.record_batch([pa.array(a[0]), pa.array(value.sum(axis=1))], names=["id", "total"])

    return compared(vectors, f, "id long, total double").groupBy("id").agg(F.sum("total").alias("total"))


def distances(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """i, j, v of the distance matrix of every group of vectors(group, id, vector), without its diagonal."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")

    def f(a: Block, b: Block, same: bool) -> Iterator[pa.RecordBatch]:
        if metric == "cosine":
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (a[1], b[1]))
            d = 1 - x @ y.T
        else:
            d = np.sqrt(np.maximum((a[1] ** 2).sum(1)[:, None] + (b[1] ** 2).sum(1) - 2 * a[1] @ b[1].T, 0))
        i, j = np.nonzero(~np.eye(len(a[0]), len(b[0]), dtype=bool) if same else np.ones(d.shape, bool))
        yield pa.record_batch([pa.array(a[0][i]), pa.array(b[0][j]), pa.array(d[i, j])], names=["i", "j", "v"])

    return compared(vectors, f, "i long, j long, v double")


def principal(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(share of the variance, components, id and projection): the first k principal components of standardised vectors.

    Sums and products are added up by the executors; the driver holds one matrix as wide as a vector.  The sign of a
    component makes its greatest entry positive.  Constant entries count as zero; without vectors there are no components.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(len(batch), -1)
            if len(x):
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "total", "square"])

    parts = vectors.where("vector is not null").select("vector").mapInArrow(moments, "n long, total array<double>, square array<double>").collect()
    if not parts:
        return np.zeros(0), np.zeros((0, 0)), vectors.select("id", F.array().cast("array<double>").alias("projection"))
    n = sum(p["n"] for p in parts)
    mean = sum(np.array(p["total"]) for p in parts) / n
    covariance = sum(np.array(p["square"]).reshape(len(mean), -1) for p in parts) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale = np.where(spread > 1e-12, spread, np.inf)
    values, axes = np.linalg.eigh(covariance / np.outer(scale, scale))
    order = np.argsort(-values)[:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(batch), -1)
            yield pa.record_batch([batch.column(0), pa.array(list((x - mean) / scale @ axes), pa.list_(pa.float64()))], names=["id", "projection"])

    kind = vectors.schema["id"].dataType.simpleString()
    projected = vectors.where("vector is not null").select("id", "vector").mapInArrow(project, f"id {kind}, projection array<double>")
    return values[order] / max(values.sum(), 1e-300), axes, projected
